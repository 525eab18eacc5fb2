"""Column functions over file text.  All of them are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# One pass of a lexer: string literals, line comments, block comments.  The
# possessive quantifiers keep the JVM matcher iterative on very long lines.
_DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
_SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
_TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_LINE_COMMENT = r"//[^\n]*+"
_BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
LEXEMES = "|".join([_DOUBLE, _SINGLE, _TEMPLATE, _LINE_COMMENT, _BLOCK_COMMENT])

# A private-use character marks match starts while line numbers are counted.
MARK = "\ue000"
MARK_STANDIN = "\ue001"


def line_count(content: Column) -> Column:
    """Number of pieces between newlines; a trailing newline adds one."""
    return F.size(F.split(content, "\n", -1))


def est_tokens(content: Column) -> Column:
    """Token estimate: a quarter of the characters, rounded up."""
    return F.ceil(F.length(content) / 4)


def _relex(content: Column, rewrite) -> Column:
    gaps = F.split(content, LEXEMES, -1)
    found = F.regexp_extract_all(content, F.lit(LEXEMES), F.lit(0))
    joined = F.zip_with(gaps, found, lambda gap, tok: F.concat(gap, F.coalesce(rewrite(tok), F.lit(""))))
    has_lexeme = content.rlike(r"""["'`]|//|/\*""")
    return F.when(has_lexeme, F.array_join(joined, "")).otherwise(content)


def _only_newlines(tok: Column) -> Column:
    return F.regexp_replace(tok, r"[^\n]+", "")


def code_text(content: Column) -> Column:
    """Text without comments; newlines stay, so line numbers do not move."""
    return _relex(
        content,
        lambda tok: F.when(tok.startswith("//"), F.lit(""))
        .when(tok.startswith("/*"), _only_newlines(tok))
        .otherwise(tok),
    )


def bare_text(content: Column) -> Column:
    """Text without comments and without the inside of string literals."""
    return _relex(
        content,
        lambda tok: F.when(tok.startswith("//"), F.lit(""))
        .when(tok.startswith("/*"), _only_newlines(tok))
        .otherwise(F.concat(F.lit('""'), _only_newlines(tok))),
    )


# Lexical forms of the decision points that are counted.
DECISION_POINTS = [
    r"\bif\s*\(",
    r"\s\?\s",
    r"\bfor\s*\([^;{}]*;",
    r"\bwhile\s*\(",
    r"(?:&&|\|\||\?\?)[^=]",
    r"\bcatch\s*[({]",
]
CASE_POINT = r"\bcase\s"


def complexity(bare: Column, compat: bool = False) -> Column:
    """1 + decision points in comment- and string-free text.

    ``compat=True`` leaves ``case`` labels out, as a literal reading of the
    node names would.
    """
    points = list(DECISION_POINTS) + ([] if compat else [CASE_POINT])
    total = F.lit(1)
    for pattern in points:
        total = total + F.regexp_count(bare, F.lit(pattern))
    return total


IMPORT_LINE = r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:([\w$*\s{},]+?)\s+from\s+)?['"]([^'"\n]+)['"]"""


def _specifier(item: Column) -> Column:
    text = F.trim(F.regexp_replace(item, r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(text, r"^type ", ""), r"^(\S+) as \1$", "$1")


def import_specifiers(clause: Column) -> Column:
    """Names bound by an import clause: ``a``, ``a as b`` or ``* as ns``."""
    items = F.split(F.regexp_replace(clause, r"[{}]", ","), ",")
    return F.filter(F.transform(items, _specifier), lambda x: x != "")


def extract_imports(code: Column) -> Column:
    """Import declarations as ``array<struct<source, specifiers>>``."""
    clauses = F.regexp_extract_all(code, F.lit(IMPORT_LINE), F.lit(1))
    sources = F.regexp_extract_all(code, F.lit(IMPORT_LINE), F.lit(2))
    pairs = F.zip_with(
        sources,
        clauses,
        lambda s, c: F.struct(s.alias("source"), import_specifiers(F.coalesce(c, F.lit(""))).alias("specifiers")),
    )
    return F.when(code.contains("import"), pairs).otherwise(F.array().cast("array<struct<source:string,specifiers:array<string>>>"))


EXPORT_NAMED = r"(?m)^[ \t]*export\s+(?:async\s+)?(?:const|let|var|function\*?|class)\s+([A-Za-z_$][\w$]*)"
EXPORT_LIST = r"(?m)^[ \t]*export\s*\{([^}]*)\}"
EXPORT_DEFAULT = r"(?m)^[ \t]*export\s+(default)\b"


def extract_exports(code: Column) -> Column:
    """Exported names: declarations, then lists (``a as b`` gives ``b``), then default."""
    named = F.regexp_extract_all(code, F.lit(EXPORT_NAMED), F.lit(1))
    lists = F.regexp_extract_all(code, F.lit(EXPORT_LIST), F.lit(1))
    listed = F.flatten(
        F.transform(
            lists,
            lambda body: F.filter(
                F.transform(F.split(body, ","), lambda x: F.regexp_replace(F.trim(x), r"^[\s\S]*\sas\s+", "")),
                lambda x: x != "",
            ),
        )
    )
    default = F.regexp_extract_all(code, F.lit(EXPORT_DEFAULT), F.lit(1))
    return F.when(code.contains("export"), F.concat(named, listed, default)).otherwise(F.array().cast("array<string>"))


def mask_secret(text: Column) -> Column:
    """First four characters, stars, and the last four when longer than twelve."""
    return F.when(F.length(text) <= 12, F.concat(F.substring(text, 1, 4), F.lit("****"))).otherwise(
        F.concat(F.substring(text, 1, 4), F.lit("****"), F.right(text, F.lit(4)))
    )


def snippet(content: Column, line: Column, context: int = 1) -> Column:
    """Up to 200 characters of the lines around ``line``; empty for line 0."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(F.lit(1), line - context)
    last = F.least(F.size(lines), line + context)
    body = F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")
    return F.when(line > 0, F.substring(body, 1, 200)).otherwise(F.lit(""))


def match_lines(source: Column, pattern: str) -> Column:
    """1-based line of every match of ``pattern``, in match order.

    Each match start is marked in place, so one split by newline gives all the
    line numbers in time linear in the text.
    """
    marked = F.regexp_replace(F.translate(source, MARK, MARK_STANDIN), pattern, MARK + "$0")
    rows = F.transform(
        F.split(marked, "\n", -1),
        lambda text, i: F.array_repeat(i + 1, F.length(text) - F.length(F.replace(text, F.lit(MARK), F.lit("")))),
    )
    return F.flatten(F.filter(rows, lambda x: F.size(x) > 0))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def _join_words(text: Column) -> Column:
    words = F.split(text, r"[-_\s]", -1)
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(upper_first(w))), "")


def to_pascal(text: Column) -> Column:
    return upper_first(_join_words(text))


def to_camel(text: Column) -> Column:
    joined = _join_words(text)
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 2**31 - 1))


def to_kebab(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"([A-Z])", "-$1")), r"^-", "")


# Casing classes in the order they are tested.
CASINGS = [
    ("PascalCase", r"^[A-Z][a-zA-Z0-9]*$"),
    ("camelCase", r"^[a-z][a-zA-Z0-9]*$"),
    ("kebab-case", r"^[a-z][a-z0-9-]*$"),
]


def casing_of(name: Column) -> Column:
    """Casing class; an all-lowercase word counts as camel case."""
    out = F.when(name.rlike(CASINGS[0][1]), F.lit(CASINGS[0][0]))
    for label, pattern in CASINGS[1:]:
        out = out.when(name.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit("other"))


TRUNCATION_MARKER = "\n\n... [content truncated] ...\n\n"


def truncate_middle(content: Column, max_tokens: Column) -> Column:
    """Keep 60 % of the budget from the head and 20 % from the tail."""
    chars = (max_tokens * 4).cast("int")
    head = F.floor(chars * F.lit(0.6)).cast("int")
    tail = F.floor(chars * F.lit(0.2)).cast("int")
    cut = F.concat(
        F.substr(content, F.lit(1), head),
        F.lit(TRUNCATION_MARKER),
        F.substr(content, F.length(content) - tail + 1, tail),
    )
    return F.when(F.length(content) <= chars, content).otherwise(cut)


def truncated_length(length: Column, max_tokens: Column) -> Column:
    """Length of ``truncate_middle`` without building the text."""
    chars = max_tokens * 4
    kept = F.floor(chars * F.lit(0.6)) + F.floor(chars * F.lit(0.2)) + len(TRUNCATION_MARKER)
    return F.when(length <= chars, length).otherwise(kept).cast("bigint")
