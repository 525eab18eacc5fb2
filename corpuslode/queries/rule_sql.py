"""Oracle SQL of a rule scan: one SELECT per rule over the corpus."""

from __future__ import annotations

import re
from collections.abc import Sequence

from ..rules import Clause, Rule
from . import corpus


def quoted(value: str) -> str:
    """A literal; what keeps the JVM from trying a match again, which that engine lacks and does not need, is left out."""
    value = re.sub(r"\(\?=\[\\w\$\]\*\?(\(\?:[^()]*\))\)\(\[\\w\$\]\+\+\)", r"([\\w$]*\1[\\w$]*)", value)
    for held, plain in (("]*+", "]*"), (")*+", ")*"), ("]++", "]+"), ("(?>", "(?:")):
        value = value.replace(held, plain)
    return corpus.quoted(value)


def _list(words: Sequence[str]) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def _atom(field: str, words: Sequence[str]) -> str:
    if field in ("path", "content"):
        return "(" + " OR ".join(f"contains({field}, {quoted(w)})" for w in words) + ")"
    if field == "imports":
        return f"list_has_any(import_sources, {_list(words)})"
    if field == "import_named":
        return f"list_has_any(import_names, {_list(words)})"
    call = "contains" if field == "import_part" else "starts_with"
    tests = " OR ".join(f"{call}(s, {quoted(w)})" for w in words)
    return f"len(list_filter(import_sources, lambda s: {tests})) > 0"


def clause_sql(clause: Clause) -> str:
    test = "(" + " OR ".join(_atom(f, words) for f, words in clause.atoms) + ")"
    return f"NOT {test}" if clause.negated else test


def file_test_sql(rule: Rule) -> str:
    tests = [clause_sql(c) for c in rule.where]
    if rule.frameworks:
        tests.append("framework IN (" + ", ".join(quoted(f) for f in rule.frameworks) + ")")
    return " AND ".join(tests) or "true"


def _judge_sql(rule: Rule) -> str:
    value = "value"
    if rule.erase:
        value = f"regexp_replace(value, {quoted(rule.erase)}, ' ', 'g')"
    tests = []
    if rule.keep:
        tests.append("(" + " OR ".join(f"contains({value}, {quoted(w)})" for w in rule.keep) + ")")
    if rule.keep_rx:
        tests.append(f"regexp_matches({value}, {quoted(rule.keep_rx)})")
    if rule.drop:
        tests.append("NOT (" + " OR ".join(f"contains({value}, {quoted(w)})" for w in rule.drop) + ")")
    if rule.drop_rx:
        tests.append(f"NOT regexp_matches({value}, {quoted(rule.drop_rx)})")
    if rule.near:
        before, after, wanted, words = rule.near
        around = f"array_to_string(string_split(content, chr(10))[greatest(1, line - {before - 1}):line + {after}], ' ')"
        around = f"lower({around})" if wanted else around
        near = "(" + " OR ".join(f"contains({around}, {quoted(w)})" for w in words) + ")"
        tests.append(near if wanted else f"NOT {near}")
    return " AND ".join(tests) or "true"


def _snippet_sql(rule: Rule) -> str:
    if rule.snippet == "none":
        return "''"
    if rule.snippet == "masked":
        return ("CASE WHEN length(matched) <= 12 THEN substring(matched, 1, 4) || '****' "
                "ELSE substring(matched, 1, 4) || '****' || right(matched, 4) END")
    if rule.snippet == "context":
        return "substring(array_to_string(string_split(content, chr(10))[greatest(1, line - 1):line + 1], chr(10)), 1, 200)"
    return f"substring(matched, 1, {rule.snippet_chars})" if rule.snippet_chars else "matched"


def _braces(depth: int) -> str:
    """An object with so many levels of objects in it; the fixture has fewer."""
    return r"\{[^{}]*" + (rf"(?:{_braces(depth - 1)}[^{{}}]*)*" if depth else "") + r"\}"


# Rules about a call and its object, typed out anew: head, what joins the object to it, whether it must be there,
# and what becomes of a hit: ``m`` is its text without what lies deeper.
_PATH = r"""\s*\(\s*['"`][^'"`\n]*['"`]\s*"""
_OWN = r"[{,]\s*(?:async\s+)?(?:NAMES)\s*[:,}(]"
_SENSITIVE = r"""(?i)^[^'"`]*['"`][^'"`]*(?:/api/[^'"`]*(?:user|admin|account|payment|order|profile|settings)|/private/|/internal/)"""
_GUARDED = r"""(?i)^[^'"`]*['"`][^'"`]*(?:/users?|/admin|/account|/settings|/profile|/api/private|/payment|/order)"""
BLOCK_RULES = {
    ("Potentially Unprotected Sensitive Route", False): (
        r"\.((?i:get|post|put|delete|patch))" + _PATH, r",\s*", "all",
        f"regexp_matches(m, {quoted(_SENSITIVE)}) AND NOT regexp_matches(m, {quoted(_OWN.replace('NAMES', 'preHandler|onRequest|beforeHandler|middleware'))})"),
    ("Route Without Schema Validation", False): (
        r"\.((?i:post|put|patch))" + _PATH, r",\s*", "all", f"NOT regexp_matches(m, {quoted(_OWN.replace('NAMES', 'schema'))})"),
    ("Sensitive Route Without Auth Hook", False): (
        r"\.((?i:get|post|put|delete|patch))" + _PATH, r",\s*", "all",
        f"regexp_matches(m, {quoted(_GUARDED)}) AND NOT regexp_matches(m, {quoted(_OWN.replace('NAMES', 'preHandler|onRequest|beforeHandler'))})"),
    ("fastify-routes", False): (r"\.((?i:get|post|put|delete|patch|options|head))" + _PATH, r",\s*", "all", "true"),
    ("fastify-routes", True): (r"\.(route)\s*\(\s*", "", "all", "true"),
    ("kafka-producers", False): (r"\b((?i:\w*producer\w*))\.send\s*\(\s*", "", "objects", "true"),
    ("kafka-consumers", False): (r"\b((?i:\w*consumer\w*))\.subscribe\s*\(\s*", "", "objects", "true"),
    ("pinia-stores", False): (r"""\bdefineStore\s*\(\s*['"]([^'"\n]*)['"]""", r"\s*,\s*", "nothing", "true"),
}


def _without_inner(text: str, what: str) -> str:
    """SQL for a hit with the brackets in its object emptied, the innermost ones first."""
    if what == "nothing":
        return text
    body = f"regexp_extract({text}, '^[^{{]*\\{{([\\s\\S]*)\\}}$', 1)"
    inner = body
    for _ in range(6):
        inner = f"regexp_replace({inner}, '\\{{[^{{}}]*\\}}', chr(1), 'g')" if what == "objects" else (
            f"regexp_replace(regexp_replace(regexp_replace({inner}, '\\{{[^{{}}()\\[\\]]*\\}}', chr(1), 'g'), '\\([^{{}}()\\[\\]]*\\)', chr(2), 'g'), "
            "'\\[[^{}()\\[\\]]*\\]', chr(3), 'g')")
    filled = f"replace(replace(replace({inner}, chr(1), '{{}}'), chr(2), '()'), chr(3), '[]')"
    return f"CASE WHEN contains({text}, '{{') THEN regexp_extract({text}, '^[^{{]*\\{{', 0) || {filled} || '}}' ELSE {text} END"


def _block_select(rule: Rule) -> str:
    head, link, emptied, judge = BLOCK_RULES[rule.title, rule.block.required]
    pattern = quoted(head + (_braces(7) if rule.block.required else f"(?:{link}{_braces(7)})?"))
    found = f"""SELECT *, regexp_extract_all(code, {pattern}, 0) AS ms, regexp_extract_all(code, {pattern}, 1) AS vs,
        string_split_regex(code, {pattern}) AS gaps FROM imported WHERE {file_test_sql(rule)} AND regexp_matches(code, {pattern})"""
    rows = f"""SELECT project, path, framework, content, vs[i] AS named, {_without_inner("ms[i]", emptied)} AS m,
        len(string_split(array_to_string(gaps[1:i], '') || array_to_string(ms[1:i - 1], ''), chr(10))) AS line
      FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM ({found}))"""
    value = "named" if rule.kind else "m"
    return (f"SELECT project, path, framework, {quoted(rule.rule_id)} AS rule_id, line AS line, {value} AS value, {_snippet_sql(rule)} AS snippet "
            f"FROM (SELECT *, m AS matched FROM ({rows})) WHERE {judge}")


def rule_select(rule: Rule) -> str:
    """Rows ``(project, path, framework, rule_id, line, value, snippet)`` of one rule."""
    if rule.block is not None:
        return _block_select(rule)
    rid, where = quoted(rule.rule_id), file_test_sql(rule)
    head = f"SELECT project, path, framework, {rid} AS rule_id"
    if rule.pattern is None:
        return f"{head}, 0 AS line, '' AS value, '' AS snippet FROM imported WHERE {where}"
    pattern = quoted(rule.pattern)
    if rule.more_than is not None and rule.line_zero:
        count = f"len(regexp_extract_all({rule.on}, {pattern})) > {rule.more_than}"
        return f"{head}, 0 AS line, '' AS value, '' AS snippet FROM imported WHERE {where} AND {count}"
    # Position of a match: the text before it is the split pieces and matches so far.
    found = f"""SELECT *, regexp_extract_all({rule.on}, {pattern}, 0) AS ms,
        regexp_extract_all({rule.on}, {pattern}, {rule.group}) AS vs,
        string_split_regex({rule.on}, {pattern}) AS gaps FROM imported
      WHERE {where} AND regexp_matches({rule.on}, {pattern})"""
    rows = f"""SELECT project, path, framework, content, i, len(ms) AS n, ms[i] AS matched, vs[i] AS value,
        1 + len(string_split(array_to_string(gaps[1:i], '') || array_to_string(ms[1:i - 1], ''), chr(10))) - 1 AS line
      FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM ({found}))"""
    tests = [_judge_sql(rule)]
    if rule.first_only or rule.more_than is not None:
        tests.append("i = 1")
    if rule.more_than is not None:
        tests.append(f"n > {rule.more_than}")
    line = "0" if rule.line_zero else "line"
    return f"{head}, {line} AS line, value, {_snippet_sql(rule)} AS snippet FROM ({rows}) WHERE {' AND '.join(tests)}"


def scan_sql(rules: Sequence[Rule]) -> str:
    return "\nUNION ALL ".join(rule_select(r) for r in rules)


def rules_values(rules: Sequence[Rule], name: str = "rules") -> str:
    rows = ",\n".join(
        f"({quoted(r.rule_id)}, {quoted(r.family)}, {quoted(r.category)}, {quoted(r.owasp)}, {quoted(r.severity)}, "
        f"{quoted(r.status)}, {quoted(r.title)}, {quoted(r.cwe)}, CAST({float(r.confidence)} AS DOUBLE), {str(r.auto_fixable).lower()}, "
        f"{quoted(r.kind)}, {quoted(r.name) if r.name else 'NULL'})"
        for r in rules
    )
    return (f"{name}(rule_id, family, category, owasp, severity, status, title, cwe, confidence, auto_fixable, kind, name) "
            f"AS (VALUES {rows})")
