"""The inputs of the registered queries, derived from the given tables.

Each builder has a SQL twin that the oracle inlines as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.corpus import balanced
from .templates import LINKS, PROJECT_FRAMEWORKS, PROJECTS, TEMPLATES, link_offset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to process, spread over all cores when it is few files."""
    return balanced(table(spark, sf_dir, name))


def quoted(text: str) -> str:
    """SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"


# ---------------------------------------------------------------- source files


def _fill(text: Column, doc_id: Column) -> Column:
    out = F.replace(text, F.lit("@ID@"), doc_id.cast("string"))
    for link in LINKS:
        out = F.replace(out, F.lit(f"@{link}@"), (doc_id + link_offset(link)).cast("string"))
    return out


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per document: a template body followed by the whole text as comment."""
    doc, text = F.col("doc_id"), F.col("text")
    pick = (F.floor(doc / PROJECTS) % len(TEMPLATES) + 1).cast("int")
    path = F.element_at(F.array(*[F.lit(p) for p, _ in TEMPLATES]), pick)
    body = F.element_at(F.array(*[F.lit(b) for _, b in TEMPLATES]), pick)
    framework = F.element_at(F.array(*[F.lit(f) for f in PROJECT_FRAMEWORKS]), (doc % PROJECTS + 1).cast("int"))
    return text_table(spark, sf_dir, "documents").select(
        F.concat(F.lit("proj"), (doc % PROJECTS).cast("string")).alias("project"),
        _fill(path, doc).alias("path"),
        F.concat(_fill(body, doc), F.lit("// "), F.replace(text, F.lit("\n"), F.lit("\n// "))).alias("content"),
        framework.alias("framework"),
        doc,
    )


def _fill_sql(text: str) -> str:
    out = f"replace({text}, '@ID@', CAST(doc_id AS VARCHAR))"
    for link in LINKS:
        out = f"replace({out}, '@{link}@', CAST(doc_id + {link_offset(link)} AS VARCHAR))"
    return out


def code_files_sql() -> str:
    rows = ",\n".join(f"({i}, {quoted(p)}, {quoted(b)})" for i, (p, b) in enumerate(TEMPLATES))
    frameworks = ", ".join(quoted(f) for f in PROJECT_FRAMEWORKS)
    return f"""templates(tid, tpath, body) AS (VALUES {rows}),
code_files AS MATERIALIZED (
  SELECT 'proj' || CAST(doc_id % {PROJECTS} AS VARCHAR) AS project,
         {_fill_sql('tpath')} AS path,
         {_fill_sql('body')} || '// ' || replace(text, chr(10), chr(10) || '// ') AS content,
         ([{frameworks}])[doc_id % {PROJECTS} + 1] AS framework,
         doc_id
  FROM documents JOIN templates ON (doc_id // {PROJECTS}) % {len(TEMPLATES)} = tid)"""


# Lexing and import parsing for the oracle, in list functions of its own engine.
_LEX = "|".join([
    r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"',
    r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'",
    r"`[^`\\]*(?:\\(?:.|\n)[^`\\]*)*`",
    r"//[^\n]*",
    r"/\*(?:.|\n)*?\*/",
])


def lexed_sql() -> str:
    """``lexed``: code_files plus ``code`` and ``bare`` text."""
    gaps, toks = f"string_split_regex(content, {quoted(_LEX)})", f"regexp_extract_all(content, {quoted(_LEX)})"
    newlines = "regexp_replace(t, '[^\\n]+', '', 'g')"
    comment = f"CASE WHEN starts_with(t, '//') THEN '' WHEN starts_with(t, '/*') THEN {newlines}"
    return f"""pieces AS MATERIALIZED (SELECT *, {gaps} AS gaps, {toks} AS toks FROM code_files),
lexed AS MATERIALIZED (
  SELECT project, path, content, framework, doc_id,
    array_to_string(list_transform(gaps, lambda g, i: g || coalesce(list_transform(toks, lambda t: {comment} ELSE t END)[i], '')), '') AS code,
    array_to_string(list_transform(gaps, lambda g, i: g || coalesce(list_transform(toks, lambda t: {comment} ELSE '""' || {newlines} END)[i], '')), '') AS bare
  FROM pieces)"""


IMPORT_SQL = r"""(?m)^[ \t]*import\s+(?:type\s+)?(?:([\w$*\s{},]+?)\s+from\s+)?['"]([^'"\n]+)['"]"""


def imported_sql() -> str:
    """``imported``: lexed plus ``import_sources``, ``import_names`` and clauses."""
    clause = "regexp_replace(regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g')), '^type ', ''), '^(\\S+) as \\1$', '\\1')"
    clean = "trim(regexp_replace(s, '\\s+', ' ', 'g'))"
    specs = (
        "list_filter(list_transform(string_split(regexp_replace(c, '[{}]', ',', 'g'), ','), "
        f"lambda s: regexp_replace({clean}, '^type ', '')), lambda s: s <> '')"
    )
    return f"""clauses AS MATERIALIZED (
  SELECT *, regexp_extract_all(code, {quoted(IMPORT_SQL)}, 2) AS import_sources,
         regexp_extract_all(code, {quoted(IMPORT_SQL)}, 1) AS import_clauses FROM lexed),
imported AS MATERIALIZED (
  SELECT *, list_transform(import_clauses, lambda c: {specs}) AS import_specs,
         flatten(list_transform(import_clauses, lambda c, i: list_transform({specs}, lambda s: import_sources[i] || ':' || s))) AS import_names
  FROM clauses)"""


def corpus_ctes(level: str = "files") -> str:
    parts = [code_files_sql()]
    if level in ("code", "imports"):
        parts.append(lexed_sql())
    if level == "imports":
        parts.append(imported_sql())
    return ",\n".join(parts)
