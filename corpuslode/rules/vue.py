"""Vue and Nuxt rules."""

from __future__ import annotations

from .model import Rule, has, lacks, numbered

A01, A02, A03 = "A01:2021-Broken Access Control", "A02:2021-Cryptographic Failures", "A03:2021-Injection"
VUE = ("vue3", "nuxt3")

# Words the rules look for.
USER_INPUT_WORDS = ["user", "input", "form", "data", "content", "html", "message"]
SANITISERS = ["DOMPurify", "sanitize", "xss", "escapeHtml"]
PUBLIC_CONFIG_KEYS = ["secret", "password", "apiKey", "privateKey", "token", "auth"]
CONFIG_SECRETS = ["apiKey", "secret", "privateKey"]
VALIDATORS = ["zod", "yup", "joi", "validate", "schema"]
INPUT_READERS = [
    ("getQuery", r"(?i)getQuery\s*\(\s*event\s*\)"),
    ("readBody", r"(?i)readBody\s*\(\s*event\s*\)"),
    ("getRouterParam", r"(?i)getRouterParam\s*\("),
]
STORE_FIELDS = ["password", "secret", "token", "creditCard", "ssn"]

_SERVER_ROUTE = (has(path=["server/"]), has(path=["/api/"]))
_PUBLIC_BLOCK = r"runtimeConfig\s*:\s*\{[^}]*public\s*:\s*\{[^}]+\}"
_STATE_BLOCK = r"state\s*:\s*\(\s*\)\s*=>\s*\(\s*\{[^}]+\}"
_V_HTML = r"""(?i)v-html\s*=\s*["']([^"']+)["']"""


def _rule(title, severity, confidence, cwe, pattern, gate=(), owasp=A02, **extra) -> Rule:
    return Rule(
        rule_id="", family="vue", category="vue_nuxt", owasp=owasp, frameworks=VUE,
        title=title, severity=severity, confidence=confidence, cwe=cwe, pattern=pattern, gate=gate, **extra,
    )


RULES = numbered("VUE", [
    _rule("Potential XSS via v-html", "high", 0.85, "CWE-79", _V_HTML, ("v-html",), owasp=A03, group=1,
          keep=tuple(USER_INPUT_WORDS), where=(has(path=[".vue"]), lacks(content=SANITISERS))),
    _rule("Potential XSS via v-html", "medium", 0.65, "CWE-79", _V_HTML, ("v-html",), owasp=A03, group=1,
          status="review", drop=tuple(USER_INPUT_WORDS), where=(has(path=[".vue"]), lacks(content=SANITISERS))),
    *[
        _rule(f"Sensitive Key in Public Runtime Config: {key}", "high", 0.9, "CWE-200", _PUBLIC_BLOCK,
              ("runtimeconfig", "public"), keep_rx=rf"(?i){key}\s*:", first_only=True, snippet="none",
              where=(has(path=["nuxt.config"]),))
        for key in PUBLIC_CONFIG_KEYS
    ],
    *[
        _rule("Hardcoded Secret in nuxt.config", "critical", 0.95, "CWE-798",
              rf"""(?i){key}\s*:\s*['"`]([^'"`]{{10,}})['"`]""", (key.lower(),), group=1, drop_rx=r"(?i)^process\.env",
              snippet="masked", where=(has(path=["nuxt.config"]),))
        for key in CONFIG_SECRETS
    ],
    *[
        _rule(f"Unvalidated Input from {name}", "medium", 0.6, "CWE-20", pattern, (name.lower(),), owasp=A03,
              status="review", more_than=0, line_zero=True, snippet="none",
              where=(*_SERVER_ROUTE, lacks(content=VALIDATORS)))
        for name, pattern in INPUT_READERS
    ],
    _rule("Potential SQL Injection in Server Route", "high", 0.8, "CWE-89", None, owasp=A03, snippet="none",
          where=(*_SERVER_ROUTE, has(content=[".query("]), has(content=["${"]))),
    *[
        _rule(f"Sensitive Data in {call}", "medium", 0.65, "CWE-200",
              rf"""(?i){call}\s*\(\s*['"`][^'"`]*(?:token|password|secret|auth)[^'"`]*['"`]""", (call.lower(),),
              status="review")
        for call in ("useState", "useAsyncData")
    ],
    _rule("Client-Only Route Protection", "medium", 0.7, "CWE-284", None, owasp=A01, status="review", snippet="none",
          where=(has(path=["middleware/"]), has(content=["navigateTo"]), has(content=["process.client"]),
                 lacks(content=["process.server", "event.node.req"]))),
    _rule("Auth Middleware Without Abort", "low", 0.5, "CWE-284", None, owasp=A01, status="review", snippet="none",
          where=(has(path=["middleware/"]), has(content=["auth", "Auth"]), lacks(content=["abortNavigation"]))),
    *[
        _rule(f"Sensitive Field in Pinia Store: {field}", "medium", 0.6, "CWE-200", _STATE_BLOCK, ("state",),
              keep_rx=f"(?i){field}", first_only=True, line_zero=True, snippet="none", status="review",
              where=(has(path=["stores/"], content=["defineStore"]),))
        for field in STORE_FIELDS
    ],
])
