"""Coverage queries: report parsing, gaps, summaries, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import COVERAGE_EXCLUDE, COVERAGE_INCLUDE, TEST_GLOBS, glob_filter, glob_regex
from ..operators import coverage as cv, facts, ranking as rk
from ..session import cut
from ..sources import coverage_reports as reports
from .corpus import code_files, corpus_ctes, quoted, table
from .facts import FACTS_SQL
from .registry import query

# Line hits of the labelled documents' files: every line item is a covered or missed line.
HITS_SQL = """
line_hits AS (SELECT d.doc_id, l_orderkey * 10 + l_linenumber AS line, l_orderkey, l_linenumber, l_returnflag,
   CAST(floor(l_quantity) AS BIGINT) % (2 + d.doc_id % 10) AS hits
  FROM lineitem JOIN labels d ON d.doc_id = l_partkey // 2)"""

COVERAGE_SQL = f"""{HITS_SQL},
merged AS (SELECT doc_id, line, min(l_orderkey) AS l_orderkey, min(l_linenumber) AS l_linenumber, min(l_returnflag) AS l_returnflag, max(hits) AS hits FROM line_hits GROUP BY doc_id, line),
cov AS (SELECT doc_id, count(*) AS lines_total, count(*) FILTER (hits > 0) AS lines_covered,
  count(*) FILTER (l_linenumber = 1) AS functions_total, count(*) FILTER (l_linenumber = 1 AND hits > 0) AS functions_covered,
  count(*) FILTER (l_returnflag = 'R') AS branches_total, count(*) FILTER (l_returnflag = 'R' AND hits > 0) AS branches_covered,
  coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (hits = 0), '') AS uncovered_lines,
  coalesce(string_agg('fn' || l_orderkey, ',' ORDER BY line) FILTER (l_linenumber = 1 AND hits = 0), '') AS uncovered_functions
 FROM merged GROUP BY doc_id),
pcov AS (SELECT *, CASE WHEN lines_total > 0 THEN lines_covered / CAST(lines_total AS DOUBLE) * 100 ELSE 0.0 END AS lines_pct,
  CASE WHEN functions_total > 0 THEN functions_covered / CAST(functions_total AS DOUBLE) * 100 ELSE 0.0 END AS functions_pct,
  CASE WHEN branches_total > 0 THEN branches_covered / CAST(branches_total AS DOUBLE) * 100 ELSE 0.0 END AS branches_pct FROM cov)"""


def _line_hits(spark, sf):
    item = table(spark, sf, "lineitem")
    doc = F.floor(F.col("l_partkey") / 2).alias("doc_id")
    hits = F.floor("l_quantity") % (2 + F.col("doc_id") % 10)
    rows = item.select(doc, "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").join(
        table(spark, sf, "labels").select("doc_id"), "doc_id")
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    return rows.select("doc_id", "l_orderkey", "l_linenumber", "l_returnflag", line, hits.alias("hits")).groupBy("doc_id", "line").agg(
        F.min("l_orderkey").alias("l_orderkey"), F.min("l_linenumber").alias("l_linenumber"),
        F.min("l_returnflag").alias("l_returnflag"), F.max("hits").alias("hits"))


def lcov_text(spark, sf):
    """One LCOV record per labelled document's file."""
    line, hits = F.col("line").cast("string"), F.col("hits").cast("string")
    first, branch = F.col("l_linenumber") == 1, F.col("l_returnflag") == "R"
    name = F.concat(F.lit("fn"), F.col("l_orderkey").cast("string"))
    entry = F.struct(
        "line",
        F.when(first, F.concat_ws("\n", F.concat(F.lit("FN:"), line, F.lit(","), name), F.concat(F.lit("FNDA:"), hits, F.lit(","), name))).alias("fn"),
        F.concat(F.lit("DA:"), line, F.lit(","), hits).alias("da"),
    )
    packed = _line_hits(spark, sf).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(entry)).alias("e"), F.count_if(branch).alias("brf"), F.count_if(branch & (F.col("hits") > 0)).alias("brh"))
    files = code_files(spark, sf).select("doc_id", "project", "path")
    part = lambda f: F.array_join(F.array_compact(F.transform("e", lambda x: x[f])), "\n")
    record = F.concat_ws("\n", F.lit("TN:"), F.concat(F.lit("SF:/repo/"), F.col("path")), part("fn"), part("da"),
                         F.concat(F.lit("BRF:"), F.col("brf").cast("string")), F.concat(F.lit("BRH:"), F.col("brh").cast("string")), F.lit(""))
    return files.join(packed, "doc_id").select("project", record.alias("record"))


def istanbul_text(spark, sf):
    """One Istanbul report per labelled document's file."""
    entry = F.struct("line", "hits", "l_orderkey", "l_linenumber", "l_returnflag")
    packed = _line_hits(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    key = lambda x: x["line"].cast("string")
    pairs = lambda xs, f: F.map_from_entries(F.transform(xs, f))
    first = F.filter("e", lambda x: x["l_linenumber"] == 1)
    body = F.struct(
        pairs(F.col("e"), lambda x: F.struct(key(x), x["hits"])).alias("s"),
        pairs(F.col("e"), lambda x: F.struct(key(x), F.struct(F.struct(x["line"].alias("line")).alias("start")))).alias("statementMap"),
        pairs(first, lambda x: F.struct(key(x), x["hits"])).alias("f"),
        pairs(first, lambda x: F.struct(key(x), F.struct(F.concat(F.lit("fn"), x["l_orderkey"].cast("string")).alias("name")))).alias("fnMap"),
        pairs(F.filter("e", lambda x: x["l_returnflag"] == "R"), lambda x: F.struct(key(x), F.array(x["hits"]))).alias("b"),
    )
    files = code_files(spark, sf).select("doc_id", "project", "path")
    content = F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("/repo/"), F.col("path"))), F.array(body)))
    return files.join(packed, "doc_id").select("project", content.alias("content"))


def _coverage(spark, sf):
    return reports.parse_lcov(lcov_text(spark, sf), root="/repo")


def _flat(cov):
    return cov.withColumn("uncovered_lines", F.array_join(F.transform("uncovered_lines", lambda x: x.cast("string")), ",")).withColumn(
        "uncovered_functions", F.array_join("uncovered_functions", ","))


_REPORT_SQL = lambda: f"""WITH {corpus_ctes()}, {COVERAGE_SQL}
SELECT project, path, lines_total, lines_covered, lines_pct, functions_total, functions_covered, functions_pct,
  branches_total, branches_covered, branches_pct, lines_total AS statements_total, lines_covered AS statements_covered, lines_pct AS statements_pct,
  uncovered_lines, uncovered_functions
FROM code_files JOIN pcov USING (doc_id)"""


@query("S3 A12", _REPORT_SQL)
def lcov_coverage(spark, sf):
    return _flat(_coverage(spark, sf))


@query("S4 A13", _REPORT_SQL)
def istanbul_coverage(spark, sf):
    cov = reports.parse_istanbul(istanbul_text(spark, sf), root="/repo")
    ordered = cov.withColumn("uncovered_lines", F.array_sort("uncovered_lines"))
    return _flat(ordered)


@query("A14", lambda: f"""WITH {corpus_ctes()}, {COVERAGE_SQL}
SELECT project, sum(lines_covered) / CAST(sum(lines_total) AS DOUBLE) * 100 AS lines_pct, sum(functions_covered) / CAST(sum(functions_total) AS DOUBLE) * 100 AS functions_pct,
  sum(branches_covered) / CAST(sum(branches_total) AS DOUBLE) * 100 AS branches_pct, sum(lines_covered) / CAST(sum(lines_total) AS DOUBLE) * 100 AS statements_pct
FROM code_files JOIN pcov USING (doc_id) GROUP BY project""")
def overall_coverage(spark, sf):
    return cv.overall_coverage(_coverage(spark, sf))


def _files(spark, sf):
    return glob_filter(code_files(spark, sf), COVERAGE_INCLUDE, COVERAGE_EXCLUDE)


def _gaps(spark, sf):
    files = _files(spark, sf)
    measured = facts.file_facts(files)
    named = facts.import_rows(files).select("project", "path", "source")
    return cv.coverage_gaps(measured, _coverage(spark, sf), cv.importer_counts(measured, named))


def gap_ctes() -> str:
    return f"""{corpus_ctes('imports')}, {FACTS_SQL}, {COVERAGE_SQL},
cfiles AS (SELECT * FROM facts WHERE regexp_matches(path, {quoted(glob_regex(COVERAGE_INCLUDE))}) AND NOT regexp_matches(path, {quoted(glob_regex(COVERAGE_EXCLUDE))})),
mention AS (SELECT DISTINCT project, path, regexp_replace(regexp_replace(s, '\\.(tsx?|jsx?|vue)$', ''), '^.*/', '') AS name
            FROM (SELECT project, path, unnest(import_sources) AS s FROM cfiles)),
named AS (SELECT *, regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS name FROM cfiles),
imp AS (SELECT n.project, n.path, count(m.path) FILTER (m.path <> n.path) AS importers FROM named n LEFT JOIN mention m ON m.project = n.project AND m.name = n.name GROUP BY ALL),
crit AS (SELECT n.*, importers, CASE
   WHEN regexp_matches(lower(path), '/utils/|/lib/|/core/|/services/|/api/|/store|/composables/') THEN 'core'
   WHEN regexp_matches(lower(path), '/hooks/|/providers/|/context/') THEN 'important'
   WHEN importers >= 5 THEN 'core' WHEN importers >= 3 THEN 'important'
   WHEN regexp_matches(lower(path), '/components/|/pages/') THEN 'standard' ELSE 'peripheral' END AS criticality FROM named n JOIN imp USING (project, path)),
gaps AS MATERIALIZED (SELECT *, CASE
   WHEN criticality = 'core' AND lp = 0 AND complexity > 30 THEN 'critical' WHEN criticality = 'core' AND lp < 80 THEN 'critical'
   WHEN criticality = 'important' AND lp < 80 THEN 'high' WHEN complexity > 50 AND lp < 50 THEN 'high'
   WHEN criticality = 'standard' AND lp < 80 THEN 'medium' ELSE 'low' END AS priority
  FROM (SELECT c.*, p.* EXCLUDE (doc_id), coalesce(lines_pct, 0.0) AS lp FROM crit c LEFT JOIN pcov p USING (doc_id))
  WHERE lines_total IS NULL OR lines_pct < 80 OR functions_pct < 80 OR branches_pct < 75)"""


@query("J3 J6 C1 C2 C3 C4 C5 P29", lambda: f"""WITH {gap_ctes()}
SELECT project, path, criticality, priority, CAST(complexity AS INT) AS complexity, lp AS lines_pct, importers,
  array_to_string(list_filter([
    CASE WHEN lp = 0 THEN 'No test coverage' END,
    CASE WHEN lp > 0 AND lp < 80 THEN 'Line coverage ' || printf('%.1f', lp) || '% below threshold 80%' END,
    CASE WHEN lp > 0 AND functions_pct < 80 THEN 'Function coverage ' || printf('%.1f', functions_pct) || '% below threshold 80%' END,
    CASE criticality WHEN 'core' THEN 'Core utility - high impact if bugs present' WHEN 'important' THEN 'Important file - widely used across codebase' END,
    CASE WHEN complexity > 50 THEN 'High complexity (' || complexity || ') - error-prone' WHEN complexity > 30 THEN 'Moderate complexity (' || complexity || ') - needs testing' END],
    lambda x: x IS NOT NULL), '; ') AS reasons,
  CASE WHEN coalesce(functions_pct, 0) = 0 THEN exports ELSE uncovered_functions END AS untested_functions
FROM gaps""")
def coverage_gaps(spark, sf):
    return _gaps(spark, sf).select(
        "project", "path", "criticality", "priority", "complexity", "lines_pct", "importers",
        F.array_join("reasons", "; ").alias("reasons"), F.array_join("untested_functions", ",").alias("untested_functions"))


@query("A15 F4", lambda: f"""WITH {gap_ctes()}
SELECT project, n AS files, coalesce(g, 0) AS gaps, coalesce(u, 0) AS untested, coalesce(p, 0) AS partially_tested, coalesce(c, 0) AS urgent, n - coalesce(g, 0) AS tested
FROM (SELECT project, count(*) AS n FROM cfiles GROUP BY project) LEFT JOIN
 (SELECT project, count(*) AS g, count(*) FILTER (lp = 0) AS u, count(*) FILTER (lp > 0 AND lp < 100) AS p, count(*) FILTER (priority IN ('critical','high')) AS c FROM gaps GROUP BY project) USING (project)""")
def coverage_gap_summary(spark, sf):
    return cv.gap_summary(_files(spark, sf), _gaps(spark, sf))


@query("W2 W5", lambda: f"""WITH {gap_ctes()}
SELECT project, path, priority, CAST(complexity AS INT) AS complexity,
  row_number() OVER (PARTITION BY project ORDER BY CASE priority WHEN 'critical' THEN 0 ELSE 1 END, complexity DESC, path) AS rank FROM gaps WHERE priority IN ('critical', 'high')""")
def critical_coverage_gaps(spark, sf):
    return cv.critical_gaps(cut(_gaps(spark, sf))).select("project", "path", "priority", "complexity", "rank")


@query("F4 W2 W7", lambda: f"""WITH {gap_ctes()},
k AS (SELECT *, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END AS p, -complexity AS c, length(path) * 20 AS cost FROM gaps WHERE priority IN ('critical','high','medium')),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY p, c, path) AS rank, count(*) OVER (PARTITION BY project) AS total_items FROM k),
s AS (SELECT project, CAST(least(50, greatest(5, floor(20000 / avg(cost)))) AS INT) AS page_size FROM r WHERE rank <= 3 GROUP BY project)
SELECT project, path, priority, CAST(rank AS INT) AS rank, total_items, page_size FROM r JOIN s USING (project) WHERE rank <= page_size""")
def coverage_gap_pages(spark, sf):
    """First page of gaps of at least medium priority; its size follows the rows' size."""
    gaps = _gaps(spark, sf).filter(rk.at_least(F.col("priority"), "medium", rk.PRIORITY_ORDER))
    gaps = gaps.withColumn("p", rk.rank_of(F.col("priority"), rk.PRIORITY_ORDER)).withColumn("c", -F.col("complexity"))
    gaps = cut(gaps)
    page = rk.token_sized_pages(gaps.withColumn("tokens", F.length("path") * 20), ["project"], ["p", "c", "path"], "tokens")
    return page.select("project", "path", "priority", "rank", "total_items", "page_size")


@query("P30", lambda: f"""WITH {gap_ctes()},
k AS (SELECT *, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, regexp_extract(path, '([^/]*)$', 1) AS base FROM gaps),
t AS (SELECT *, CASE
  WHEN framework IN ('react-native','expo') AND (ext IN ('.tsx','.jsx','.vue') OR contains(path,'screens') OR contains(path,'app/')) THEN 'mobile-component'
  WHEN framework IN ('react-native','expo') AND starts_with(base,'use') AND regexp_matches(path,'hooks|composables') THEN 'mobile-hook'
  WHEN framework = 'react' AND ext IN ('.tsx','.jsx','.vue') THEN 'component'
  WHEN framework = 'react' AND starts_with(base,'use') AND regexp_matches(path,'hooks|composables') THEN 'hook'
  WHEN framework IN ('vue3','nuxt3') AND regexp_matches(path,'/stores?/') THEN 'store'
  WHEN framework = 'nuxt3' AND contains(path,'/server/') AND regexp_matches(path,'/api/|/routes/') THEN 'server-route'
  WHEN framework IN ('vue3','nuxt3') AND ext IN ('.tsx','.jsx','.vue') THEN 'vue-component'
  WHEN framework IN ('vue3','nuxt3') AND starts_with(base,'use') AND regexp_matches(path,'hooks|composables') THEN 'composable'
  WHEN regexp_matches(path,'utils|lib|helpers') THEN 'utility' ELSE 'unit' END AS test_kind,
  CASE WHEN coalesce(functions_pct, 0) = 0 THEN exports ELSE uncovered_functions END AS uf FROM k)
SELECT project, path, test_kind, regexp_replace(path, '(\\.[^./]+)$', '.test\\1') AS test_path,
  CASE WHEN test_kind = 'utility' AND uf <> '' AND len(string_split(uf, ',')) > 5 THEN 'high' WHEN complexity > 50 THEN 'high' WHEN complexity > 30 THEN 'medium' ELSE 'low' END AS effort FROM t""")
def test_suggestions(spark, sf):
    return cv.suggest_tests(_gaps(spark, sf)).select("project", "path", "test_kind", "test_path", "effort")


@query("A32", lambda: f"""WITH {corpus_ctes()},
t AS (SELECT project, path, content, row_number() OVER (PARTITION BY project ORDER BY path) AS rank FROM code_files
      WHERE {' OR '.join(f"regexp_matches(path, {quoted(glob_regex([g]))})" for g in TEST_GLOBS)}),
f AS (SELECT * FROM t WHERE rank <= 5),
i AS (SELECT project, string_agg(DISTINCT s, ' ; ' ORDER BY s) AS import_statements FROM (SELECT project, unnest(regexp_extract_all(content, 'import\\s+.*\\s+from\\s+[''"].+[''"]')) AS s FROM f) GROUP BY project)
SELECT project, import_statements,
  max_by(CASE WHEN contains(content,'vi.mock') OR contains(content,'vitest') THEN 'vi.mock' WHEN contains(content,'jest.mock') THEN 'jest.mock' END, rank) AS mocking_library,
  max_by(CASE WHEN contains(content,'render(') THEN 'render' WHEN contains(content,'mount(') THEN 'mount' END, rank) AS render_function,
  coalesce(max_by(CASE WHEN contains(content,'expect(') THEN 'expect' WHEN contains(content,'assert.') THEN 'assert' END, rank), 'expect') AS assertion_library,
  CASE WHEN bool_or(contains(content,'beforeEach')) THEN 'beforeEach' ELSE '' END AS setup_patterns, count(*) AS example_files
FROM f JOIN i USING (project) GROUP BY project, import_statements""")
def test_profiles(spark, sf):
    rows = cv.test_profile(code_files(spark, sf))
    return rows.withColumn("import_statements", F.array_join("import_statements", " ; ")).withColumn("setup_patterns", F.array_join("setup_patterns", ","))
