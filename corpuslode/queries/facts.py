"""Per-file facts: lines, tokens, complexity, exports, classes, flags, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..functions.paths import GRAPH_EXCLUDE, GRAPH_INCLUDE, PURPOSES, SECURITY_WORDS, glob_filter, glob_regex
from ..functions.text import CASE_POINT, DECISION_POINTS, EXPORT_DEFAULT, EXPORT_LIST, EXPORT_NAMED
from ..operators import facts, findings as fd
from .corpus import code_files, corpus_ctes, quoted, table, text_table
from .registry import query

_POINTS = " + ".join(f"len(regexp_extract_all(bare, {quoted(p)}))" for p in [*DECISION_POINTS, CASE_POINT])
_LISTED = (f"flatten(list_transform(regexp_extract_all(code, {quoted(EXPORT_LIST)}, 1), lambda b: "
           "list_filter(list_transform(string_split(b, ','), lambda x: regexp_replace(trim(x), '^(?:.|\\n)*\\sas\\s+', '')), lambda x: x <> '')))")

FACTS_SQL = f"""
facts AS MATERIALIZED (SELECT *, len(string_split(content, chr(10))) AS lines, length(content) AS chars,
  CAST(ceil(length(content) / 4) AS BIGINT) AS tokens, 1 + {_POINTS} AS complexity,
  array_to_string(list_concat(list_concat(regexp_extract_all(code, {quoted(EXPORT_NAMED)}, 1), {_LISTED}),
    regexp_extract_all(code, {quoted(EXPORT_DEFAULT)}, 1)), ',') AS exports FROM imported)"""

_CLASS_SQL = """CASE WHEN contains(lp, '/components/') THEN 'component' WHEN contains(lp, '/hooks/') THEN 'hook'
 WHEN contains(lp, '/composables/') THEN 'composable' WHEN contains(lp, '/stores/') OR contains(lp, '/store/') THEN 'store'
 WHEN contains(lp, '/services/') OR contains(lp, '/api/') THEN 'service' WHEN contains(lp, '/providers/') OR contains(lower(stem), 'provider') THEN 'provider'
 WHEN starts_with(stem, 'use') AND length(stem) > 3 THEN CASE WHEN contains(lp, 'vue') THEN 'composable' ELSE 'hook' END ELSE 'utility' END"""


@query("P1 P2 P4 P5 P7 P8 P10", lambda: f"""WITH {corpus_ctes('imports')}, {FACTS_SQL},
f AS (SELECT *, lower(path) AS lp, regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS stem FROM facts)
SELECT project, path, CAST(lines AS INT) AS lines, tokens, CAST(complexity AS INT) AS complexity, CAST(len(import_sources) AS INT) AS imports, exports,
  {_CLASS_SQL} AS file_class,
  CASE {' '.join(f"WHEN contains(lp, '{w}') THEN {quoted(p)}" for w, p in PURPOSES)} ELSE 'Core module' END AS purpose,
  regexp_matches(lp, '{'|'.join(SECURITY_WORDS)}') AS security_related FROM f""")
def file_facts(spark, sf):
    rows = facts.file_facts(code_files(spark, sf))
    return rows.select("project", "path", "lines", "tokens", "complexity", F.size("imports").alias("imports"),
                       F.array_join("exports", ",").alias("exports"), "file_class", "purpose", "security_related")


@query("P6", lambda: f"""WITH {corpus_ctes('imports')},
f AS (SELECT *, regexp_matches(code, '\\buse\\w*') AS hooky, list_contains(import_sources, 'react') AS r, list_contains(import_sources, 'react-native') AS rn,
  list_contains(import_sources, 'vue') OR len(list_filter(import_sources, lambda s: starts_with(s, '@vue/'))) > 0 AS v,
  ends_with(path, '.vue') AS vf, len(list_filter(import_sources, lambda s: starts_with(s, 'expo'))) > 0 AS ex FROM imported)
SELECT project, path, r OR rn AS is_react, v OR vf AS is_vue, rn OR ex AS is_react_native, hooky AND (r OR rn) AS has_hooks, vf OR (hooky AND v) AS has_composables,
  (rn OR ex) AND len(list_filter(import_sources, lambda s: starts_with(s, '@react-navigation/') OR s = 'expo-router' OR starts_with(s, 'expo-router/'))) > 0 AS has_navigation,
  (rn OR ex) AND (list_has_any(import_sources, ['react-native-reanimated','react-native-animatable','lottie-react-native']) OR len(list_filter(import_names, lambda s: starts_with(s, 'react-native:') AND contains(s, 'Animated'))) > 0) AS has_animations,
  (rn OR ex) AND list_has_any(import_sources, ['@react-native-async-storage/async-storage','@react-native-community/async-storage','expo-secure-store']) AS has_async_storage,
  (rn OR ex) AND regexp_matches(code, '\\bPlatform\\.(OS|select|Version)\\b') AS has_platform_code,
  (rn OR ex) AND regexp_matches(code, '\\b(NativeModules|NativeEventEmitter)\\.') AS has_native_modules,
  CAST(CASE WHEN rn OR ex THEN len(regexp_extract_all(code, {quoted(facts.NAVIGATION_NAMES)})) ELSE 0 END AS INT) AS navigation_hooks FROM f""")
def file_flags(spark, sf):
    return facts.file_flags(code_files(spark, sf))


@query("A7 A8", lambda: f"""WITH {corpus_ctes('imports')}, {FACTS_SQL}
SELECT project, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (regexp_matches(lower(path), '{'|'.join(SECURITY_WORDS)}')) AS security_files,
 avg(complexity) AS avg_complexity, CAST(max(complexity) AS INT) AS max_complexity, count(*) FILTER (complexity > 20) AS complex_files FROM facts GROUP BY project""")
def corpus_metrics(spark, sf):
    return fd.corpus_metrics(facts.file_facts(code_files(spark, sf)))


@query("S2", lambda: f"""WITH {corpus_ctes()} SELECT project, path FROM code_files
WHERE regexp_matches(path, {quoted(glob_regex(GRAPH_INCLUDE))}) AND NOT regexp_matches(path, {quoted(glob_regex(GRAPH_EXCLUDE))})""")
def glob_selection(spark, sf):
    return glob_filter(code_files(spark, sf), GRAPH_INCLUDE, GRAPH_EXCLUDE).select("project", "path")


@query("P20 P21 P22", """WITH n AS (SELECT p_partkey, replace(p_name, ' ', CASE p_partkey % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE '' END) AS name, p_brand FROM part),
w AS (SELECT *, list_transform(regexp_split_to_array(name, '[-_\\s]'), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END) AS ws FROM n),
j AS (SELECT *, array_to_string(ws, '') AS joined FROM w),
c AS (SELECT p_partkey, name, upper(joined[1]) || joined[2:] AS pascal, lower(joined[1]) || joined[2:] AS camel FROM j)
SELECT p_partkey, name, pascal, camel, regexp_replace(lower(regexp_replace(pascal, '([A-Z])', '-\\1', 'g')), '^-', '') AS kebab,
 CASE WHEN regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') THEN 'PascalCase' WHEN regexp_matches(name, '^[a-z][a-zA-Z0-9]*$') THEN 'camelCase'
      WHEN regexp_matches(name, '^[a-z][a-z0-9-]*$') THEN 'kebab-case' ELSE 'other' END AS casing,
 'src/' || name || '.d.ts' AS path, name || '.d' AS stem, '.ts' AS ext, 'src' AS dir FROM c""")
def name_casing(spark, sf):
    """Case conversion, casing class and path parts over part names."""
    sep = F.when(F.col("p_partkey") % 3 == 0, "-").when(F.col("p_partkey") % 3 == 1, "_").otherwise("")
    rows = table(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit(" "), sep).alias("name"))
    name, path = F.col("name"), F.col("path")
    rows = rows.withColumn("path", F.concat(F.lit("src/"), name, F.lit(".d.ts")))
    pascal = text.to_pascal(name)
    return rows.select("p_partkey", "name", pascal.alias("pascal"), text.to_camel(name).alias("camel"), text.to_kebab(pascal).alias("kebab"),
                       text.casing_of(name).alias("casing"), "path", paths.stem(path).alias("stem"), paths.extname(path).alias("ext"), paths.dirname(path).alias("dir"))


@query("P23 P2", """SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens,
 CASE WHEN length(text) <= 800 THEN text ELSE substring(text, 1, 480) || chr(10) || chr(10) || '... [content truncated] ...' || chr(10) || chr(10) || right(text, 160) END AS shortened
FROM documents""")
def truncated_documents(spark, sf):
    body = F.col("text")
    return text_table(spark, sf, "documents").select("doc_id", text.est_tokens(body).alias("tokens"), text.truncate_middle(body, F.lit(200)).alias("shortened"))


@query("P1 P5", lambda: f"""WITH {corpus_ctes('code')}
SELECT project, path, CAST(len(string_split(content, chr(10))) AS INT) AS lines, CAST(len(string_split(code, chr(10))) AS INT) AS code_lines,
  CAST(len(string_split(bare, chr(10))) AS INT) AS bare_lines, sha256(code) AS code_hash, sha256(bare) AS bare_hash FROM lexed""")
def stripped_text(spark, sf):
    """Comment and string stripping keeps every line where it was."""
    c = F.col("content")
    code, bare = text.code_text(c), text.bare_text(c)
    return code_files(spark, sf).select("project", "path", text.line_count(c).alias("lines"), text.line_count(code).alias("code_lines"),
                                        text.line_count(bare).alias("bare_lines"), F.sha2(code, 256).alias("code_hash"), F.sha2(bare, 256).alias("bare_hash"))
