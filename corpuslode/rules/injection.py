"""Injection rules: SQL, markup, command, document store, code and path injection."""

from __future__ import annotations

from .model import Rule, has, lacks, numbered

# A call target that is a plain name: not a member and not part of a word.
BARE_CALL = r"(?m)(?:^|[^.\w$\n])"
CONCAT_ARG = r"""(?:"[^"\n]*"|'[^'\n]*'|`[^`]*`|[\w$.\[\]]+)\s*\+"""
TEMPLATE_ARG = r"`[^`]*\$\{"

# Names the rules look for.
SQL_WORDS = ["SELECT", "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE"]
SHELL_CALLS = ["exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync"]
DOCUMENT_CALLS = ["find", "findOne", "findOneAndUpdate", "updateOne", "updateMany", "deleteOne", "deleteMany"]
FILE_CALLS = [
    "readFile", "readFileSync", "writeFile", "writeFileSync", "readdir", "readdirSync",
    "unlink", "unlinkSync", "rmdir", "rmdirSync", "access", "accessSync",
    "stat", "statSync", "mkdir", "mkdirSync",
]

_SHELL = "|".join(SHELL_CALLS)
_DOCS = "|".join(DOCUMENT_CALLS)
_FILES = "|".join(FILE_CALLS)
_SHELL_GATE = (has(imports=["child_process", "node:child_process"]),)
_DOC_GATE = (has(imports=["mongodb"], import_part=["mongoose"]),)
_FILE_GATE = (has(imports=["fs", "node:fs", "fs/promises"]),)


def _rule(title, severity, confidence, cwe, pattern, gate=(), **extra) -> Rule:
    extra.setdefault("on", "code")
    extra.setdefault("snippet", "context")
    return Rule(
        rule_id="", family="injection", category="injection", owasp="A03:2021-Injection",
        title=title, severity=severity, confidence=confidence, cwe=cwe, pattern=pattern, gate=gate, **extra,
    )


RULES = numbered("INJ", [
    _rule("SQL Injection via Template Literal", "high", 0.85, "CWE-89", r"`[^`]*\$\{[^`]*`", ("${",),
          erase=r"\$\{[^}]*\}", keep_rx="(?i)" + "|".join(SQL_WORDS), drop_rx=r"\$\d+"),
    _rule("SQL Injection via String Concatenation", "high", 0.9, "CWE-89",
          r"\.query\s*\(\s*" + CONCAT_ARG, (".query",)),
    _rule("SQL Injection - Missing Parameterized Query", "high", 0.85, "CWE-89",
          r"\.query\s*\(\s*`[^`]*\$\{[^`]*`\s*\)", (".query", "${")),
    _rule("Potential XSS via dangerouslySetInnerHTML", "high", 0.8, "CWE-79",
          r"dangerouslySetInnerHTML\s*=", ("dangerouslysetinnerhtml",)),
    _rule("Potential XSS via v-html Directive", "high", 0.8, "CWE-79", r"v-html\s*=\s*\{", ("v-html",)),
    _rule("Potential XSS via v-html Directive", "high", 0.8, "CWE-79",
          r"""v-html\s*=\s*["'][^"']*["']""", ("v-html",), on="content", snippet="match",
          frameworks=("vue3", "nuxt3"), where=(has(path=[".vue"]),)),
    _rule("Potential XSS via innerHTML Assignment", "medium", 0.75, "CWE-79",
          r"\.innerHTML\s*\+?=[^=]", (".innerhtml",)),
    _rule("Potential XSS via document.write", "medium", 0.7, "CWE-79",
          r"document\.write(?:ln)?\s*\(", ("document.write",)),
    _rule("Command Injection via Template Literal", "critical", 0.95, "CWE-78",
          BARE_CALL + rf"(?:{_SHELL})\s*\(\s*{TEMPLATE_ARG}", ("${",), where=_SHELL_GATE),
    _rule("Command Injection via String Concatenation", "critical", 0.95, "CWE-78",
          BARE_CALL + rf"(?:{_SHELL})\s*\(\s*{CONCAT_ARG}", ("+",), where=_SHELL_GATE),
    _rule("Potential NoSQL Injection via Object Spread", "high", 0.7, "CWE-943",
          rf"\.(?:{_DOCS})\s*\(\s*\{{[^{{}}]*\.\.\.", ("...",), where=_DOC_GATE, status="review"),
    _rule("Potential NoSQL Injection - Direct Variable Query", "medium", 0.6, "CWE-943",
          rf"\.(?:{_DOCS})\s*\(\s*[A-Za-z_$][\w$]*\s*[,)]", (), where=_DOC_GATE, status="review"),
    _rule("Code Injection via eval()", "critical", 0.95, "CWE-94", BARE_CALL + r"eval\s*\(", ("eval",)),
    _rule("Code Injection via new Function()", "critical", 0.9, "CWE-94",
          r"""new\s+Function\s*\(\s*(?:[^()]*,\s*)?(?:[A-Za-z_$`]|"[^"\n]*"\s*\+|'[^'\n]*'\s*\+)""", ("function",)),
    _rule("Code Injection via setTimeout() String Argument", "high", 0.85, "CWE-94",
          BARE_CALL + r"""setTimeout\s*\(\s*["'`]""", ("settimeout",), auto_fixable=True),
    _rule("Code Injection via setInterval() String Argument", "high", 0.85, "CWE-94",
          BARE_CALL + r"""setInterval\s*\(\s*["'`]""", ("setinterval",), auto_fixable=True),
    _rule("Path Traversal via Template Literal", "high", 0.75, "CWE-22",
          rf"\b(?:fs|promises)\.(?:{_FILES})\s*\(\s*{TEMPLATE_ARG}", ("${",), where=_FILE_GATE),
    _rule("Path Traversal via String Concatenation", "high", 0.75, "CWE-22",
          rf"\b(?:fs|promises)\.(?:{_FILES})\s*\(\s*{CONCAT_ARG}", ("+",), where=_FILE_GATE),
])
