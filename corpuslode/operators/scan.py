"""Multi-rule scan: every rule over every file in one pass, one row per hit.

Patterns are literals, so each is compiled once per task.  Rules are indexed by
their frameworks and a literal that every match contains; a file looks for each
literal once and runs only the rules below those it holds, and of these only
the ones whose other tests (path, further literals, imports) it passes.
There is no shuffle: a scan is one narrow stage over the corpus.  Rules about a
call and its object share one bracket index per file (``functions/blocks.py``).

Rules become Spark SQL expressions; a catalogue of hundreds of rules is parsed
faster as text than it is built column by column.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.blocks import find_blocks
from ..functions.text import MARK, MARK_STANDIN
from ..rules import Clause, Rule
from .facts import with_imports

HIT = "array<struct<rule_id:string,line:int,matched:string,value:string,snippet:string>>"


def literal(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _any(tests: Sequence[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def _contains(text: str, words: Sequence[str]) -> str:
    return _any([f"contains({text}, {literal(w)})" for w in words])


def _atom(field: str, words: Sequence[str]) -> str:
    if field in ("path", "content"):
        return _contains(field, words)
    if field == "imports":
        return f"arrays_overlap(import_sources, array({', '.join(literal(w) for w in words)}))"
    if field == "import_part":
        return f"exists(import_sources, s -> {_contains('s', words)})"
    if field == "import_prefix":
        return f"exists(import_sources, s -> {_any([f'startswith(s, {literal(w)})' for w in words])})"
    pairs = [w.split(":", 1) for w in words]
    tests = [f"(i.source = {literal(s)} AND array_contains(i.specifiers, {literal(n)}))" for s, n in pairs]
    return f"exists(imports, i -> {_any(tests)})"


def _clause(clause: Clause) -> str:
    test = _any([_atom(field, words) for field, words in clause.atoms])
    return f"NOT {test}" if clause.negated else test


def applies(rule: Rule, known: str | None = None) -> str:
    """The file-level part of a rule, cheapest tests first; the frameworks and a literal that are ``known`` to hold are left out."""
    tests = []
    if rule.frameworks and known is None:
        tests.append(f"framework IN ({', '.join(literal(f) for f in rule.frameworks)})")
    cheap = [c for c in rule.where if all(f == "path" for f, _ in c.atoms)]
    tests += [_clause(c) for c in cheap]
    tests += [f"contains(lowered, {literal(word)})" for word in rule.gate if word != known]
    tests += [_clause(c) for c in rule.where if c not in cheap]
    return " AND ".join(tests) or "true"


# One element of a pattern: an escaped character, a class, flags, the start of a group, or any other character.
_ELEMENT = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[a-z]+\)|\(\?[a-z]*[:=!<>]*|.", re.DOTALL)


def leading_span(pattern: str) -> tuple[str, str, str] | None:
    """Head, class and rest of a pattern ``head [^c]* tail`` whose first repeated class is a greedy negated one (or ``.``); None for other shapes.

    The rest begins with the class.  The class stands outside of groups, at the
    start of a capture group, or in a group of flags that the pattern starts with.
    """
    depth, before, found = 0, "", None
    for element in _ELEMENT.finditer(pattern):
        text, repeat = element.group(), pattern[element.end():element.end() + 2]
        if text == "|" and not depth:
            return None
        if found is None and (text == "." or text[0] == "[" and len(text) > 1) and repeat[:1] in ("*", "+"):
            captured = depth == 1 and before == "("
            flagged = depth == 1 and pattern.startswith("(?i:")
            if (text != "." and text[1] != "^") or repeat[1:] in ("?", "+") or (depth and not captured and not flagged):
                return None
            rest = ("(?i:" if flagged and not captured else "") + pattern[element.start() - captured:]
            found = pattern[:element.start() - captured] + ")" * (flagged and not captured), text, rest
        if text[0] == "(" and not re.fullmatch(r"\(\?[a-z]+\)", text):
            depth += 1
            if found is None and text[1:3] in ("?<", "?=", "?!"):
                return None
        elif text == ")":
            depth -= 1
        elif text == "^" and found is None:
            return None
        before = text
    if found is None or len(re.sub(r"\(\?[a-z]+\)", "", found[0])) < 2:
        return None
    return found


def _judge(rule: Rule) -> str:
    value = f"regexp_replace(h.value, {literal(rule.erase)}, ' ')" if rule.erase else "h.value"
    tests = []
    if rule.keep:
        tests.append(_contains(value, rule.keep))
    if rule.keep_rx:
        tests.append(f"rlike({value}, {literal(rule.keep_rx)})")
    if rule.drop:
        tests.append("NOT " + _contains(value, rule.drop))
    if rule.drop_rx:
        tests.append(f"NOT rlike({value}, {literal(rule.drop_rx)})")
    if rule.near:
        before, after, wanted, words = rule.near
        first = f"greatest(1, h.line - {before - 1})"
        around = f"array_join(slice(lines, {first}, h.line + {after} - {first} + 1), ' ')"
        tests.append(_contains(f"lower({around})", words) if wanted else "NOT " + _contains(around, words))
    return " AND ".join(tests)


def _snippet(rule: Rule) -> str:
    if rule.snippet == "none":
        return "''"
    if rule.snippet == "masked":
        return ("CASE WHEN length(h.matched) <= 12 THEN concat(substring(h.matched, 1, 4), '****') "
                "ELSE concat(substring(h.matched, 1, 4), '****', right(h.matched, 4)) END")
    if rule.snippet == "context":
        first = "greatest(1, h.line - 1)"
        return f"substring(array_join(slice(lines, {first}, h.line + 2 - {first}), '\\n'), 1, 200)"
    return f"substring(h.matched, 1, {rule.snippet_chars})" if rule.snippet_chars else "h.matched"


def _row(rule: Rule, line: str, matched: str = "''", value: str = "''", snippet: str = "''") -> str:
    return (f"named_struct('rule_id', {literal(rule.rule_id)}, 'line', int({line}), 'matched', {matched}, "
            f"'value', {value}, 'snippet', {snippet})")


def rule_hits(rule: Rule, at: int = 0, known: str | None = None) -> str:
    """SQL for the hits of one rule in one file: an array of structs, or null.

    Hits of a block rule stand at ``at`` in the column ``blocks``.
    """
    test = applies(rule, known)
    if rule.pattern is None:
        return f"CASE WHEN {test} THEN array({_row(rule, '0')}) END"

    source, pattern = rule.on, literal(rule.pattern)
    if rule.block is not None:
        judge = _judge(rule)
        hits = f"filter(blocks[{at}], h -> {judge})" if judge else f"blocks[{at}]"
        return f"CASE WHEN {test} AND size(blocks[{at}]) > 0 THEN transform({hits}, h -> {_row(rule, 'h.line', 'h.matched', 'h.value', _snippet(rule))}) END"
    span = leading_span(rule.pattern)
    tried, full = (skipping(*span), rf"\A(?:{rule.pattern})\z") if span else (rule.pattern, None)
    seen = literal(span[0]) if span else pattern
    if rule.more_than is not None and rule.line_zero:
        found = f"regexp_extract_all({source}, {literal(tried)}, 0)"
        found = f"filter({found}, m -> rlike(m, {literal(full)}))" if full else found
        return f"CASE WHEN {test} AND rlike({source}, {seen}) AND size({found}) > {rule.more_than} THEN array({_row(rule, '0')}) END"
    return f"CASE WHEN {test} AND rlike({source}, {seen}) THEN {_located(rule, source, tried, full)} END"


def skipping(head: str, span: str, rest: str) -> str:
    """The pattern ``head rest``, but a head without a match takes its whole span.

    Where one head finds no tail before its class stops, no head within that
    stretch does, so a stretch is read once however many heads it holds.  What
    such a head takes is no match of the pattern and told from one by that.
    """
    return f"{head}(?:{rest}|{span}*+)"


def _located(rule: Rule, source: str, tried: str, full: str | None) -> str:
    """Rows of a rule's hits in a text; of what is found as ``tried`` only matches of ``full`` count.

    Every match start is marked in place of the text without marks of its own
    (see ``unmarked``); one split by newline then yields the line of every match
    in time linear in the text.
    """
    pattern = literal(tried)
    marked = f"regexp_replace({source}_unmarked, {pattern}, '{MARK}$0')"
    lines = f"flatten(transform(split({marked}, '\\n', -1), (l, i) -> array_repeat(i + 1, length(l) - length(replace(l, '{MARK}', '')))))"
    parts = [lines, f"regexp_extract_all({source}, {pattern}, 0)"]
    if rule.group:
        parts.append(f"regexp_extract_all({source}, {pattern}, {rule.group})")
    value = "z['2']" if rule.group else "z['1']"
    hits = f"transform(arrays_zip({', '.join(parts)}), z -> named_struct('line', z['0'], 'matched', z['1'], 'value', {value}))"
    if full:
        hits = f"filter({hits}, h -> rlike(h.matched, {literal(full)}))"
    if rule.more_than is not None:
        hits = f"element_at(transform(array({hits}), a -> slice(a, 1, CASE WHEN size(a) > {rule.more_than} THEN 1 ELSE 0 END)), 1)"
    elif rule.first_only:
        hits = f"slice({hits}, 1, 1)"
    if judge := _judge(rule):
        hits = f"filter({hits}, h -> {judge})"
    return f"transform({hits}, h -> {_row(rule, '0' if rule.line_zero else 'h.line', 'h.matched', 'h.value', _snippet(rule))})"


def unmarked(source: str) -> Column:
    """A text column in which a stand-in takes the place of the mark; made once for all rules, and only where a text holds the mark."""
    text = F.col(source)
    return F.when(text.contains(MARK), F.translate(text, MARK, MARK_STANDIN)).otherwise(text).alias(f"{source}_unmarked")


def literal_frequencies(files: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many files each literal of the rules occurs; one pass, one row."""
    words = sorted({w for r in rules for w in r.gate})
    if not words:
        return {}
    row = files.select(F.lower("content").alias("lowered")).agg(*[F.count_if(F.col("lowered").contains(w)) for w in words]).first()
    return dict(zip(words, row))


def rule_index(rules: Sequence[Rule], frequencies: dict[str, int] | None = None) -> dict[tuple[tuple[str, ...], str], list[int]]:
    """Places of rules under their frameworks and one literal that every match contains, the rarest known one, else the longest.

    Rules without a literal stand under an empty one.
    """
    index: dict[tuple[tuple[str, ...], str], list[int]] = {}
    for n, rule in enumerate(rules):
        word = min(rule.gate, key=lambda w: ((frequencies or {}).get(w, 0), -len(w), w), default="")
        index.setdefault((rule.frameworks, word), []).append(n)
    return index


def scan(files: DataFrame, rules: Sequence[Rule], frequencies: dict[str, int] | None = None) -> DataFrame:
    """All hits of ``rules``: ``(project, path, rule_id, line, matched, value, snippet)``.

    ``files`` needs ``project, path, content, framework``.  The outer explode keeps
    the optimizer from testing the size of the array first, which would run every
    regex twice.  Rules are indexed by a literal: a file that lacks it asks no more
    of the rules below.  ``frequencies`` (see ``literal_frequencies``) make the
    rarest literals the keys; rows are the same with any.
    """
    prepared = with_imports(files.select("project", "path", "content", "framework"))
    prepared = prepared.withColumn("lowered", F.lower(F.col("content"))).withColumn(
        "lines", F.split(F.col("content"), "\n", -1)
    ).select("*", unmarked("content"), unmarked("code"))
    headed = [rule for rule in rules if rule.block is not None]
    if headed:
        any_head = " OR ".join(f"({applies(r)} AND rlike(code, {literal(r.pattern)}))" for r in headed)
        text = F.expr(f"CASE WHEN {any_head} THEN code END")
        prepared = prepared.withColumn("blocks", find_blocks(text, [(r.pattern, r.group, r.block) for r in headed]))
    groups = []
    for (frameworks, word), members in rule_index(rules, frequencies).items():
        tests = [f"framework IN ({', '.join(literal(f) for f in frameworks)})"] if frameworks else []
        tests += [f"contains(lowered, {literal(word)})"] if word else []
        found = ", ".join(rule_hits(rules[n], headed.index(rules[n]) if rules[n].block is not None else 0, word) for n in members)
        groups.append(f"CASE WHEN {' AND '.join(tests) or 'true'} THEN flatten(filter(array({found}), x -> x IS NOT NULL)) END")
    hits = F.expr(f"flatten(filter(array({', '.join(groups)}), x -> x IS NOT NULL))")
    return (
        prepared.select("project", "path", "framework", F.explode_outer(hits).alias("hit"))
        .filter("hit IS NOT NULL")
        .select("project", "path", "framework", "hit.*")
    )


def rule_table(spark, rules: Sequence[Rule]) -> DataFrame:
    """The catalogue as a table: one small row per rule, fixed by the program."""
    rows = [
        (r.rule_id, r.family, r.polarity, r.category, r.owasp, r.severity, r.status, r.title, r.cwe,
         float(r.confidence), r.auto_fixable, r.kind, r.name)
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, family string, polarity string, category string, owasp string, severity string, "
        "status string, title string, cwe string, confidence double, auto_fixable boolean, kind string, name string",
    )


def findings(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Scan and describe: one row per hit with its rule's category, severity and title."""
    hits = scan(files, rules)
    return hits.join(F.broadcast(rule_table(files.sparkSession, rules)), "rule_id")
