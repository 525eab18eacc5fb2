"""Convention queries: votes, violations, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conventions as cn, ranking as rk
from .corpus import code_files, corpus_ctes, quoted
from .registry import query

VOTES_SQL = f"""
cf AS (SELECT *, '/' || path AS rooted, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '([^/]+)\\.[^./]*$', 1) AS stem FROM code_files),
comp AS (SELECT *, CASE WHEN regexp_matches(stem, '^[A-Z][a-zA-Z0-9]*$') THEN 'p' WHEN regexp_matches(stem, '^[a-z][a-zA-Z0-9]*$') THEN 'c'
   WHEN regexp_matches(stem, '^[a-z][a-z0-9-]*$') THEN 'k' END AS casing FROM cf WHERE regexp_matches(rooted, {quoted(cn.COMPONENT_PATH)})),
cv AS (SELECT project, count(*) AS n, count(*) FILTER (casing = 'p') / CAST(count(*) AS DOUBLE) AS p, count(*) FILTER (casing = 'k') / CAST(count(*) AS DOUBLE) AS k,
   count(*) FILTER (casing = 'c') / CAST(count(*) AS DOUBLE) AS c FROM comp GROUP BY project),
casing AS (SELECT project, CASE WHEN p > 0.7 THEN 'PascalCase' WHEN k > 0.7 THEN 'kebab-case' WHEN c > 0.7 THEN 'camelCase' ELSE 'PascalCase' END AS pattern,
   CASE WHEN p > 0.7 THEN p WHEN k > 0.7 THEN k WHEN c > 0.7 THEN c ELSE 0.5 END AS confidence, n FROM cv),
imp_lines AS (SELECT project, unnest(regexp_extract_all(content, 'import\\s+.*\\s+from\\s+[''"](.+)[''"]', 1)) AS s FROM cf),
iv AS (SELECT project, count(*) FILTER (starts_with(s, '.')) AS a, count(*) FILTER (NOT starts_with(s, '.') AND NOT regexp_matches(s, '^[a-z@]')) AS b FROM imp_lines GROUP BY project),
qv AS (SELECT project, CAST(sum(len(regexp_extract_all(l, '''[^'']*'''))) AS BIGINT) AS a, CAST(sum(len(regexp_extract_all(l, '"[^"]*"'))) AS BIGINT) AS b
       FROM (SELECT project, unnest(string_split(content, chr(10))) AS l FROM cf) GROUP BY project),
style AS (SELECT project, 'imports' AS category, 'Import style' AS rule, 'relative' AS first, 'absolute' AS second, a, b FROM iv WHERE a + b > 0
   UNION ALL SELECT project, 'style', 'Quote style', 'single', 'double', a, b FROM qv WHERE a + b > 0),
voted AS (SELECT project, category, rule, CASE WHEN a / CAST(a+b AS DOUBLE) > 0.7 THEN first WHEN b / CAST(a+b AS DOUBLE) > 0.7 THEN second ELSE 'mixed' END AS pattern,
   CASE WHEN a / CAST(a+b AS DOUBLE) > 0.7 THEN a / CAST(a+b AS DOUBLE) WHEN b / CAST(a+b AS DOUBLE) > 0.7 THEN b / CAST(a+b AS DOUBLE) ELSE 0.5 END AS confidence,
   CASE WHEN a / CAST(a+b AS DOUBLE) > 0.7 THEN a WHEN b / CAST(a+b AS DOUBLE) > 0.7 THEN b ELSE a + b END AS occurrences FROM style)"""

VIOLATIONS_SQL = f"""{VOTES_SQL},
conv AS MATERIALIZED (SELECT f.project, f.framework, coalesce(c.pattern, 'PascalCase') AS casing, coalesce(i.pattern, 'mixed') AS istyle, coalesce(q.pattern, 'single') AS quotes
  FROM (SELECT project, max(framework) AS framework FROM code_files GROUP BY project) f LEFT JOIN casing c USING (project)
  LEFT JOIN (SELECT * FROM voted WHERE rule = 'Import style') i USING (project) LEFT JOIN (SELECT * FROM voted WHERE rule = 'Quote style') q USING (project)),
fc AS (SELECT cf.* EXCLUDE (framework), v.* EXCLUDE (project) FROM cf JOIN conv v USING (project)),
ln AS MATERIALIZED (SELECT project, path, i AS n, string_split(content, chr(10))[i] AS l, istyle, quotes FROM (SELECT *, unnest(generate_series(1, len(string_split(content, chr(10))))) AS i FROM fc)),
blk AS (SELECT project, path, min(n) AS first, max(n) AS last FROM ln WHERE regexp_matches(l, '^import\\s+') GROUP BY ALL),
ws AS (SELECT *, list_transform(regexp_split_to_array(stem, '[-_\\s]'), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END) AS w FROM fc),
nm AS (SELECT *, array_to_string(w, '') AS j FROM ws),
bad AS MATERIALIZED (
 SELECT project, path, 0 AS line, 'naming' AS category, 'warning' AS severity, 'Component naming' AS rule, stem AS actual, true AS auto_fixable,
   CASE casing WHEN 'PascalCase' THEN upper(j[1]) || j[2:] WHEN 'camelCase' THEN lower(j[1]) || j[2:] ELSE regexp_replace(lower(regexp_replace(stem, '([A-Z])', '-\\1', 'g')), '^-', '') END AS new_value
 FROM nm WHERE regexp_matches(rooted, {quoted(cn.COMPONENT_PATH)}) AND NOT regexp_matches(stem, CASE casing WHEN 'PascalCase' THEN '^[A-Z][a-zA-Z0-9]*$' WHEN 'camelCase' THEN '^[a-z][a-zA-Z0-9]*$' ELSE '^[a-z][a-z0-9-]*$' END)
 UNION ALL SELECT project, path, 0, 'naming', 'warning', 'Hook naming', stem, false, '' FROM fc WHERE framework IN ('react','react-native','expo') AND regexp_matches(rooted, '/hooks/|/composables/') AND NOT regexp_matches(stem, 'use[A-Z][a-zA-Z]+')
 UNION ALL SELECT project, path, 0, 'naming', 'warning', 'Composable naming', stem, false, '' FROM fc WHERE framework IN ('vue3','nuxt3') AND contains(rooted, '/composables/') AND NOT regexp_matches(stem, 'use[A-Z][a-zA-Z]+')
 UNION ALL SELECT project, path, 0, 'framework-specific', 'warning', 'Screen naming', stem, true, stem || 'Screen' FROM fc WHERE framework IN ('react-native','expo') AND regexp_matches(rooted, {quoted(cn.SCREEN_PATH)}) AND NOT ends_with(stem, 'Screen')
 UNION ALL SELECT project, path, 0, 'framework-specific', 'warning', 'Navigator naming', stem, true, stem || 'Navigator' FROM fc WHERE framework IN ('react-native','expo') AND regexp_matches(rooted, {quoted(cn.NAVIGATOR_PATH)}) AND NOT ends_with(stem, 'Navigator') AND NOT contains(stem, 'Navigation')
 UNION ALL SELECT b.project, b.path, first, 'imports', 'info', 'Import grouping', '', true, '' FROM blk b WHERE last - first + 1 > 3
   AND NOT EXISTS (SELECT 1 FROM ln x JOIN ln y ON x.project = y.project AND x.path = y.path AND y.n = x.n + 1 WHERE x.project = b.project AND x.path = b.path AND x.n >= first AND y.n <= last AND trim(x.l) = '' AND regexp_matches(y.l, '^import\\s+'))
 UNION ALL SELECT project, path, n, 'imports', 'info', 'Import style', s, false, '' FROM (SELECT ln.*, regexp_extract(l, 'from\\s+[''"](.+)[''"]', 1) AS s FROM ln JOIN blk USING (project, path) WHERE n >= first AND n <= last)
   WHERE s <> '' AND ((istyle = 'relative' AND NOT starts_with(s, '.') AND NOT regexp_matches(s, '^[a-z@]')) OR (istyle = 'absolute' AND starts_with(s, '.')))
 UNION ALL SELECT project, path, min(n), 'style', 'info', 'Quote style', CASE max(quotes) WHEN 'single' THEN 'double quotes (")' ELSE 'single quotes ('')' END, true, '' FROM ln
   WHERE (quotes = 'single' AND contains(l, '"') AND NOT contains(l, '<') AND NOT contains(l, '="')) OR (quotes = 'double' AND contains(l, '''') AND NOT regexp_matches(l, '//|/\\*')) GROUP BY project, path)"""


def _violations(spark, sf):
    files = code_files(spark, sf)
    return cn.violations(files, cn.effective_conventions(files))


@query("A16 A17 A18 A19 W16", lambda: f"""WITH {corpus_ctes()}, {VOTES_SQL},
hook AS (SELECT project, max(framework) AS fw, count(*) AS n FROM cf WHERE starts_with(base, 'use') AND regexp_matches(rooted, '/hooks/|/composables/') GROUP BY project),
ex AS (SELECT project, string_agg(path, ',' ORDER BY path) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS r FROM comp) WHERE r <= 3 GROUP BY project),
hx AS (SELECT project, string_agg(base, ',' ORDER BY path) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY path) AS r FROM cf WHERE starts_with(base, 'use') AND regexp_matches(rooted, '/hooks/|/composables/')) WHERE r <= 3 GROUP BY project)
SELECT project, 'naming' AS category, 'Component naming' AS rule, pattern, confidence, n AS occurrences, examples FROM casing JOIN ex USING (project)
UNION ALL SELECT project, 'naming', CASE WHEN fw IN ('react','react-native','expo') THEN 'Hook naming' ELSE 'Composable naming' END, 'use[A-Z][a-zA-Z]+', CAST(0.95 AS DOUBLE), n, examples FROM hook JOIN hx USING (project)
UNION ALL SELECT project, category, rule, pattern, confidence, occurrences, '' FROM voted""")
def detected_conventions(spark, sf):
    files = code_files(spark, sf)
    named = cn.component_casing(files).unionByName(cn.hook_naming(files)).withColumn("examples", F.array_join("examples", ","))
    votes = cn.import_style(files).unionByName(cn.quote_style(files)).withColumn("examples", F.lit(""))
    return named.unionByName(votes)


@query("V1 V2 V3 V4 V5 V6 V7", lambda: f"WITH {corpus_ctes()}, {VIOLATIONS_SQL} SELECT project, path, CAST(line AS INT) AS line, category, severity, rule, actual, auto_fixable, new_value FROM bad")
def convention_violations(spark, sf):
    return _violations(spark, sf).select("project", "path", "line", "category", "severity", "rule", "actual", "auto_fixable", "new_value")


@query("A20", lambda: f"""WITH {corpus_ctes()}, {VIOLATIONS_SQL},
c(category) AS (VALUES ('naming'),('structure'),('imports'),('exports'),('style'),('framework-specific')),
s AS (SELECT p.project, c.category, greatest(0, 100 - coalesce(sum(CASE b.severity WHEN 'error' THEN 10 WHEN 'warning' THEN 5 WHEN 'info' THEN 2 END), 0)) AS score
  FROM (SELECT DISTINCT project FROM code_files) p CROSS JOIN c LEFT JOIN bad b ON b.project = p.project AND b.category = c.category GROUP BY ALL)
SELECT project, CAST(round(sum(score) / 6.0) AS INT) AS overall, coalesce(string_agg(category, ',' ORDER BY category) FILTER (score >= 90), '') AS strengths,
  coalesce(string_agg(category, ',' ORDER BY category) FILTER (score < 70), '') AS weaknesses FROM s GROUP BY project""")
def consistency_scores(spark, sf):
    scores = cn.consistency_scores(_violations(spark, sf), code_files(spark, sf))
    return scores.select("project", "overall", F.array_join("strengths", ",").alias("strengths"), F.array_join("weaknesses", ",").alias("weaknesses"))


@query("A21 F3", lambda: f"""WITH {corpus_ctes()}, {VIOLATIONS_SQL}
SELECT project, {', '.join(f"count(*) FILTER (category = '{c}') AS {c.replace('-', '_')}" for c in cn.CATEGORIES)},
 count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (auto_fixable) AS auto_fixable
FROM bad WHERE severity IN ('error', 'warning') GROUP BY project""")
def violation_counts(spark, sf):
    """Counts of violations of at least warning severity."""
    found = _violations(spark, sf)
    return cn.violation_counts(found.filter(rk.at_least(F.col("severity"), "warning", rk.VIOLATION_ORDER)))


@query("A22", lambda: f"""WITH {corpus_ctes()}, {VIOLATIONS_SQL}
SELECT project, category, rule, count(*) AS fixes, arg_min(severity, path || lpad(CAST(line AS VARCHAR), 9, '0')) AS severity,
 CASE WHEN count(*) > 10 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS impact, true AS safe FROM bad WHERE auto_fixable GROUP BY project, category, rule""")
def autofix_groups(spark, sf):
    return cn.fix_groups(_violations(spark, sf))
