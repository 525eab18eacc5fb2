"""Pattern queries over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns as pt, ranking as rk
from ..rules import PATTERNS
from ..session import cut
from .corpus import code_files, corpus_ctes, quoted
from .registry import query
from .rule_sql import rule_select, rules_values

_FOUND = "\nUNION ALL ".join(rule_select(r).replace("'' AS snippet", "matched AS snippet") for r in PATTERNS)


def found_ctes() -> str:
    return f"""{corpus_ctes('imports')}, {rules_values(PATTERNS)},
occ AS MATERIALIZED (SELECT h.project, path, framework, CAST(line AS INT) AS line, kind AS type, coalesce(r.name, value) AS name, confidence, h.rule_id, snippet AS matched
  FROM ({_FOUND}) h JOIN rules r USING (rule_id))"""


@query("T1 T2 T3 T4 T5 T6 T7 T8 T9 T10 T11 T12 T13 T14 T15 T16 T17 T18 T19 T20 T21 T22 T23 T24 T25 T30",
       lambda: f"WITH {found_ctes()} SELECT project, path, line, type, name, confidence FROM occ")
def pattern_occurrences(spark, sf):
    return pt.occurrences(code_files(spark, sf)).select("project", "path", "line", "type", "name", "confidence")


@query("F11 T15 T18", lambda: f"WITH {found_ctes()} SELECT project, path, line, type, name, confidence FROM occ WHERE type IN ('hooks', 'rn-navigation', 'rn-animations')")
def selected_pattern_types(spark, sf):
    return pt.occurrences(code_files(spark, sf), ["hooks", "rn-navigation", "rn-animations"]).select("project", "path", "line", "type", "name", "confidence")


@query("T23", lambda: f"""WITH {found_ctes()} SELECT project, path, line, upper(CASE WHEN name = 'route' THEN regexp_extract(matched, 'method\\s*:\\s*[''"](\\w+)', 1) ELSE name END) AS method,
 CASE WHEN name = 'route' THEN regexp_extract(matched, 'url\\s*:\\s*[''"]([^''"]*)', 1) ELSE regexp_extract(matched, '^[^''"`]*[''"`]([^''"`\\n]*)', 1) END AS route,
 regexp_matches(matched, '\\bschema\\s*[:,}}]') AS has_schema, regexp_matches(matched, '\\b(onRequest|preHandler|preParsing|preValidation)\\s*[:,}}(]') AS has_hooks FROM occ WHERE type = 'fastify-routes'""")
def route_patterns(spark, sf):
    return pt.routes(pt.occurrences(code_files(spark, sf), ["fastify-routes"]))


@query("T26 P31", lambda: f"""WITH {found_ctes()}, q AS (SELECT *, regexp_matches(matched, '\\(\\s*[''"`]') AS lit, regexp_replace(matched, '\\$\\{{[^}}]*\\}}', ' ', 'g') AS body FROM occ WHERE type = 'postgres-queries')
SELECT project, path, line, CASE WHEN lit THEN CASE {' '.join(f"WHEN contains(upper(body), '{w}') THEN '{w}'" for w in ('SELECT','INSERT','UPDATE','DELETE','CREATE','ALTER','DROP'))} ELSE 'other' END ELSE 'other' END AS query_type,
 lit AND (regexp_matches(body, '\\$\\d+') OR ends_with(matched, ',')) AS parameterized FROM q""")
def query_patterns(spark, sf):
    return pt.queries(pt.occurrences(code_files(spark, sf), ["postgres-queries"]))


@query("T27 T28", lambda: f"""WITH {found_ctes()} SELECT project, path, line, type, name,
 coalesce(array_to_string(list_concat(regexp_extract_all(matched, 'topics?\\s*:\\s*[''"]([^''"]+)', 1), regexp_extract_all(regexp_extract(matched, 'topics\\s*:\\s*\\[([^\\]]*)\\]', 1), '[''"]([^''"]+)[''"]', 1)), ','), '') AS topics
FROM occ WHERE type IN ('kafka-producers', 'kafka-consumers')""")
def messaging_patterns(spark, sf):
    rows = pt.messaging(pt.occurrences(code_files(spark, sf), ["kafka-producers", "kafka-consumers"]))
    return rows.withColumn("topics", F.array_join("topics", ","))


@query("T29", lambda: f"""WITH {found_ctes()}, s AS (SELECT *, regexp_extract_all(matched, '\\.(\\w+)\\s*\\(', 1) AS calls FROM occ WHERE type = 'stream-tasks'),
o AS (SELECT *, list_filter(calls, lambda c: list_contains(['map','filter','fn','fnRaw','each','keyBy','withEventTime','groupBy','sumMap','branch','aggregate','toStorage','slidingWindowTime','tumblingWindowTime','sessionWindow'], c)) AS ops FROM s)
SELECT project, path, line, CASE WHEN list_contains(calls, 'fromKafka') THEN 'kafka' WHEN list_contains(calls, 'fromArray') THEN 'array' WHEN list_contains(calls, 'fromStream') THEN 'stream' ELSE 'custom' END AS source,
 array_to_string(ops, ',') AS operators, list_has_any(calls, ['slidingWindowTime','tumblingWindowTime','sessionWindow']) AS windowed, list_has_any(calls, ['toStorage','aggregate']) AS stored FROM o WHERE len(ops) > 0""")
def stream_task_patterns(spark, sf):
    rows = pt.stream_tasks(pt.occurrences(code_files(spark, sf), ["stream-tasks"]))
    return rows.withColumn("operators", F.array_join("operators", ","))


@query("T7 A25", lambda: f"""WITH {found_ctes()} SELECT project, path, line, name, 'items,token,total' AS state, 'count' AS getters, 'add,clear' AS actions FROM occ WHERE type = 'pinia-stores'""")
def store_patterns(spark, sf):
    rows = pt.stores(pt.occurrences(code_files(spark, sf), ["pinia-stores"]))
    return rows.select("project", "path", "line", "name", *[F.array_join(c, ",").alias(c) for c in ("state", "getters", "actions")])


@query("A29 T4", lambda: f"""WITH {found_ctes()} SELECT project, path, string_split(name, '.')[1] AS parent, string_agg(string_split(name, '.')[2], ',' ORDER BY line, name) AS children
FROM occ WHERE type = 'compound-components' GROUP BY ALL""")
def compound_components(spark, sf):
    rows = pt.compound_components(pt.occurrences(code_files(spark, sf), ["compound-components"]))
    return rows.withColumn("children", F.array_join("children", ","))


@query("A23", lambda: f"""WITH {found_ctes()}, c AS (SELECT project, type, count(*) AS n FROM occ GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, type) AS r FROM c)
SELECT project, CAST(sum(n) AS BIGINT) AS total_patterns, count(*) AS types, string_agg(type, ',' ORDER BY r) FILTER (r <= 5) AS most_common FROM k GROUP BY project""")
def pattern_summary(spark, sf):
    return pt.pattern_summary(pt.occurrences(code_files(spark, sf))).withColumn("most_common", F.array_join("most_common", ","))


@query("A24", lambda: f"""WITH {found_ctes()}, h AS (SELECT project, CASE WHEN starts_with(name, 'useData') THEN 'useData' ELSE name END AS name, path FROM occ WHERE type = 'custom-hooks'),
t AS (SELECT project FROM h GROUP BY project HAVING count(*) > 5)
SELECT project, name, count(DISTINCT path) AS files FROM h WHERE project IN (SELECT project FROM t) GROUP BY project, name HAVING count(DISTINCT path) >= 3""")
def recurring_custom_hooks(spark, sf):
    """Custom hooks in at least three files, after the numbered hooks of the corpus get one name."""
    found = pt.occurrences(code_files(spark, sf), ["custom-hooks"])
    return pt.recurring_hooks(found.withColumn("name", F.when(F.col("name").startswith("useData"), "useData").otherwise(F.col("name"))))


@query("A25", lambda: f"""WITH {found_ctes()} SELECT project, 'excessive-providers' AS antipattern, 'multiple' AS path, count(*) AS n FROM occ WHERE type = 'providers' GROUP BY project HAVING count(*) > 10""")
def pattern_antipatterns(spark, sf):
    return pt.antipatterns(pt.occurrences(code_files(spark, sf), ["providers", "pinia-stores"]))


@query("A26", lambda: f"""WITH {found_ctes()}, p AS (SELECT DISTINCT project, framework FROM code_files),
c AS (SELECT project, count(*) FILTER (type = 'hooks') AS h, count(*) FILTER (type = 'custom-hooks') AS k, count(*) FILTER (type = 'composables') AS c, count(*) FILTER (type = 'pinia-stores') AS s FROM occ GROUP BY project)
SELECT project, 'Functional Components with Hooks' AS practice, CASE WHEN h > 0 THEN 'follows' ELSE 'unknown' END AS status FROM p LEFT JOIN c USING (project) WHERE framework IN ('react','react-native')
UNION ALL SELECT project, 'Custom Hooks for Logic Reuse', 'follows' FROM p JOIN c USING (project) WHERE framework IN ('react','react-native') AND k > 10
UNION ALL SELECT project, 'Composition API with Composables', CASE WHEN c > 0 THEN 'follows' ELSE 'unknown' END FROM p LEFT JOIN c USING (project) WHERE framework IN ('vue3','nuxt3')
UNION ALL SELECT project, 'Pinia for State Management', 'follows' FROM p JOIN c USING (project) WHERE framework IN ('vue3','nuxt3') AND s > 0""")
def pattern_best_practices(spark, sf):
    files = code_files(spark, sf)
    return pt.best_practices(pt.occurrences(files), files)


@query("W10", lambda: f"""WITH {found_ctes()}, c AS (SELECT *, count(*) OVER (PARTITION BY project, type) AS g, count(*) OVER (PARTITION BY project) AS t,
  row_number() OVER (PARTITION BY project, type ORDER BY path, line, name, rule_id) AS r FROM occ)
SELECT project, path, line, type, name, CAST(r AS INT) AS rank FROM c WHERE r <= CASE WHEN t > 40 THEN greatest(5, floor(40 * (g / CAST(t AS DOUBLE)))) ELSE g END""")
def capped_patterns(spark, sf):
    """About forty rows per project, shared among the types by size, five at least."""
    found = cut(pt.occurrences(code_files(spark, sf)))
    return rk.proportional_cap(found, "type", ["path", "line", "name", "rule_id"], limit=40).select("project", "path", "line", "type", "name", "rank")


@query("W11", lambda: f"""WITH {found_ctes()}, g AS (SELECT project, type, count(*) AS n FROM occ GROUP BY ALL),
b AS (SELECT project, type, n FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, type) AS r FROM g) WHERE r = 1),
k AS (SELECT o.*, n, row_number() OVER (PARTITION BY o.project ORDER BY path, line, name, rule_id) AS r FROM occ o JOIN b USING (project, type))
SELECT project, type, path, line, name, CAST(r AS INT) AS rank FROM k WHERE r > (least(2, ceil(n / 10.0)) - 1) * 10 AND r <= least(2, ceil(n / 10.0)) * 10""")
def largest_pattern_page(spark, sf):
    """Second page of ten of each project's most common type."""
    found = cut(pt.occurrences(code_files(spark, sf)))
    return rk.largest_group_page(found, "type", ["path", "line", "name", "rule_id"], 2, 10).select("project", "type", "path", "line", "name", "rank")
