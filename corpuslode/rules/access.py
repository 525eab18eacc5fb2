"""Access control rules: cross-origin settings, routes, roles, object ids, cookies."""

from __future__ import annotations

from ..functions.blocks import Block
from .model import Rule, has, lacks, numbered

# The options of a call stand behind its path.
OPTIONS = Block(link=r",\s*")


def route_call(methods: list[str]) -> str:
    """A member call with a literal path."""
    return rf"""\.(?i:{'|'.join(methods)})\s*\(\s*['"`][^'"`\n]*['"`]\s*"""


def with_property(names: list[str]) -> str:
    """Options that have one of the properties themselves, not in an object within."""
    return rf"[{{,]\s*(?:async\s+)?(?:{'|'.join(names)})\s*[:,}}(]"


# Cross-origin forms (pattern, severity, status, literal in every match).
CORS_FORMS = [
    (r"""(?i)Access-Control-Allow-Origin['":\s]*['"]\*['"]""", "high", "needs_fix", ("access-control-allow-origin",)),
    (r"""(?i)cors\(\s*\{\s*origin:\s*['"]\*['"]""", "high", "needs_fix", ("cors(", "origin:")),
    (r"""(?i)origin:\s*['"]\*['"]""", "high", "needs_fix", ("origin:",)),
    (r"(?i)cors\(\s*true\s*\)", "medium", "needs_fix", ("cors(",)),
    (r"(?i)cors\(\s*\)", "medium", "review", ("cors(",)),
]

# What makes a route sensitive, and what protects it.
SENSITIVE_API = ["user", "admin", "account", "payment", "order", "profile", "settings"]
ROUTE_GUARDS = ["preHandler", "onRequest", "beforeHandler", "middleware"]
HTTP_METHODS = ["get", "post", "put", "delete", "patch"]

# Role checks.
ROLE_CHECKS = [
    (r"""(?i)role\s*===?\s*['"`]admin['"`]""", ("role", "admin")),
    (r"""(?i)role\s*===?\s*['"`]superadmin['"`]""", ("role", "superadmin")),
    (r"(?i)isAdmin\s*===?\s*(?:true|1)", ("isadmin",)),
    (r"""(?i)user\.role\s*===?\s*['"`][^'"`]+['"`]""", ("user.role",)),
    (r"""(?i)\.hasRole\s*\(\s*['"`]admin['"`]\s*\)""", (".hasrole",)),
]

# Lookups by request value and the words that show an owner check.
LOOKUPS = ["findById", "findByPk", "findOne", "findUnique", "delete", "update", "destroy"]
REQUEST_VALUES = [r"req\.params", r"request\.params", r"params\.id", r"ctx\.params"]
OWNER_WORDS = ["userId", "ownerId", "createdBy", "belongsTo"]

# Cookie flags (pattern, title, severity, literal).
COOKIE_FLAGS = [
    (r"(?i)httpOnly\s*:\s*false", "Cookie without HttpOnly flag", "high", ("httponly",)),
    (r"(?i)secure\s*:\s*false", "Cookie without Secure flag", "medium", ("secure",)),
    (r"""(?i)sameSite\s*:\s*['"`]none['"`]""", "Cookie with SameSite=None", "medium", ("samesite",)),
]


def _rule(title, severity, confidence, cwe, pattern, gate=(), **extra) -> Rule:
    return Rule(
        rule_id="", family="access", category="access_control", owasp="A01:2021-Broken Access Control",
        title=title, severity=severity, confidence=confidence, cwe=cwe, pattern=pattern, gate=gate, **extra,
    )


RULES = numbered("AC", [
    *[
        _rule("CORS Misconfiguration", severity, 0.9, "CWE-942", pattern, gate, status=status)
        for pattern, severity, status, gate in CORS_FORMS
    ],
    _rule("CORS with Credentials and Wildcard Origin", "critical", 0.95, "CWE-942", None, snippet="none",
          where=(has(content=["credentials: true"]), has(content=["origin: '*'", 'origin: "*']))),
    _rule("Potentially Unprotected Sensitive Route", "medium", 0.6, "CWE-306",
          route_call(HTTP_METHODS), (),
          on="code", status="review", snippet="context", block=OPTIONS, drop_rx=with_property(ROUTE_GUARDS),
          keep_rx=r"""(?i)^[^'"`]*['"`][^'"`]*(?:/api/[^'"`]*(?:""" + "|".join(SENSITIVE_API) + ")|/private/|/internal/)"),
    *[
        _rule("Hardcoded Role Check", "low", 0.5, "CWE-863", pattern, gate, status="review")
        for pattern, gate in ROLE_CHECKS
    ],
    _rule("Potential IDOR Vulnerability", "high", 0.65, "CWE-639",
          rf"\.(?:{'|'.join(LOOKUPS)})\s*\([^;()]*?(?:{'|'.join(REQUEST_VALUES)})", ("params",),
          on="code", status="review", snippet="context", near=(10, 5, False, tuple(OWNER_WORDS))),
    *[
        _rule(title, severity, 0.9, "CWE-614", pattern, gate, auto_fixable=True)
        for pattern, title, severity, gate in COOKIE_FLAGS
    ],
])
