"""Architecture queries over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import architecture as ar, facts, findings as fd, graph as gr
from .corpus import code_files, corpus_ctes, quoted
from .facts import FACTS_SQL
from .graph import DEGREES_SQL, EDGE_SQL, part_graph
from .registry import query


def _facts(spark, sf):
    return facts.file_facts(code_files(spark, sf))


def _layers_sql() -> str:
    tests = []
    for framework, layers in ar.LAYERS.items():
        for layer, prefixes in layers:
            starts = " OR ".join(f"starts_with(path, '{p}')" for p in prefixes)
            tests.append(f"WHEN framework = '{framework}' AND ({starts}) THEN '{layer}'")
    return "CASE " + " ".join(tests) + " END"


@query("P9", lambda: f"WITH {corpus_ctes()} SELECT project, framework, layer, count(*) AS files FROM (SELECT *, {_layers_sql()} AS layer FROM code_files) GROUP BY ALL")
def layer_sizes(spark, sf):
    return ar.assign_layer(code_files(spark, sf)).groupBy("project", "framework", "layer").agg(F.count(F.lit(1)).alias("files"))


@query("A9", lambda: f"""WITH {corpus_ctes('imports')}, {FACTS_SQL}, f AS (SELECT *, lower(path) AS lp FROM facts)
SELECT project, count(*) FILTER (contains(lp, 'routes/') OR len(list_filter(string_split(exports, ','), lambda e: contains(e, 'route') OR contains(e, 'handler'))) > 0) AS routes,
 count(*) FILTER (contains(lp, 'plugins/')) AS plugins, count(*) FILTER (contains(lp, 'services/')) AS services, count(*) FILTER (contains(lp, 'models/') OR contains(lp, 'db/')) AS models,
 count(*) FILTER (contains(lp, 'consumers/')) AS consumers, count(*) FILTER (contains(lp, 'producers/')) AS producers, count(*) FILTER (contains(lp, 'streams/')) AS streams,
 count(*) FILTER (contains(lp, 'hooks/') OR contains(lp, '/hooks.')) AS hooks, count(*) FILTER (regexp_matches(path, '^(src/)?composables/')) AS composables, count(*) FILTER (regexp_matches(path, '^(src/)?stores/')) AS stores,
 count(*) FILTER (ends_with(path, '.vue')) AS vue_files, count(*) FILTER (regexp_matches(path, '(^|/)(server|app|index)\\.[jt]s$')) AS entry_points FROM f GROUP BY project""")
def component_counts(spark, sf):
    return ar.component_counts(_facts(spark, sf))


_IMPS = "imps AS (SELECT project, unnest(import_sources) AS source FROM imported)"


@query("J12 A11", lambda: f"""WITH {corpus_ctes('imports')}, {_IMPS}, lib(pkg, how, grp, library) AS (VALUES {', '.join(str(x) for x in ar.LIBRARIES)})
SELECT DISTINCT project, grp AS "group", library FROM imps JOIN lib ON (how = 'exact' AND source = pkg) OR (how = 'prefix' AND starts_with(source, pkg))""")
def library_usage(spark, sf):
    return ar.libraries_used(facts.import_rows(code_files(spark, sf)))


@query("A10", lambda: f"""WITH {corpus_ctes('imports')}, {_IMPS}, f AS (SELECT p.project, coalesce(bool_or(source IN ('redux','@reduxjs/toolkit','react-redux')), false) AS r, coalesce(bool_or(source = 'zustand'), false) AS z, coalesce(bool_or(source IN ('mobx','mobx-react')), false) AS m
  FROM (SELECT DISTINCT project FROM code_files) p LEFT JOIN imps USING (project) GROUP BY p.project)
SELECT project, CASE WHEN r::INT + z::INT + m::INT > 1 THEN 'mixed' WHEN r THEN 'redux' WHEN z THEN 'zustand' WHEN m THEN 'mobx' ELSE 'context' END AS state_management FROM f""")
def state_management(spark, sf):
    files = code_files(spark, sf)
    return ar.state_management(facts.import_rows(files), files)


@query("P32", lambda: f"""WITH {corpus_ctes()} SELECT project, {', '.join(f"CAST(sum(len(regexp_extract_all(content, {quoted(p)}))) AS BIGINT) AS {n}" for n, p in ar.UI_PATTERNS)} FROM code_files GROUP BY project""")
def ui_element_counts(spark, sf):
    return ar.ui_counts(code_files(spark, sf))


@query("W3 F5", lambda: f"""WITH {corpus_ctes('imports')}, {FACTS_SQL}
SELECT project, path, CAST(complexity AS INT) AS complexity, CAST(lines AS INT) AS lines, row_number() OVER (PARTITION BY project ORDER BY complexity DESC, path) AS rank FROM facts""")
def complex_files(spark, sf):
    return ar.complex_files(_facts(spark, sf)).select("project", "path", "complexity", "lines", "rank")


@query("W4", lambda: f"""WITH {corpus_ctes('imports')}, {FACTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY complexity DESC, path) AS rank FROM facts WHERE exports <> '')
SELECT project, path, CAST(complexity AS INT) AS complexity, exports, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def core_modules(spark, sf):
    return ar.core_modules(_facts(spark, sf)).select("project", "path", "complexity", F.array_join("exports", ",").alias("exports"), "rank")


@query("A34", lambda: f"""WITH {corpus_ctes()}, k(framework, convention) AS (VALUES {', '.join(f"('{f}', {quoted(c)})" for f, cs in ar.FRAMEWORK_CONVENTIONS.items() for c in cs)},
 {', '.join(f"('expo', {quoted(c)})" for c in ar.FRAMEWORK_CONVENTIONS['react-native'] + ar.EXPO_CONVENTIONS)}, {', '.join(f"('nuxt3', {quoted(c)})" for c in ar.PINIA_CONVENTIONS)})
SELECT project, framework, convention FROM (SELECT DISTINCT project, framework FROM code_files) JOIN k USING (framework)""")
def framework_convention_facts(spark, sf):
    return ar.framework_conventions(code_files(spark, sf))


@query("A35", lambda: f"""WITH {corpus_ctes('imports')}, {FACTS_SQL},
t AS (SELECT project, CAST(count(*) AS DOUBLE) AS files, CAST(sum(lines) AS DOUBLE) AS lines, avg(complexity) AS avg_complexity, CAST(max(complexity) AS DOUBLE) AS max_complexity FROM facts GROUP BY project)
SELECT project, 'committed' AS scope, 'insight' AS type, path AS subject, CAST(complexity AS DOUBLE) AS value, CAST(0.9 AS DOUBLE) AS confidence FROM facts WHERE complexity >= 20
UNION ALL SELECT project, 'local', 'fact', subject, value, 1.0 FROM t UNPIVOT (value FOR subject IN (files, lines, avg_complexity, max_complexity))""")
def architecture_insights(spark, sf):
    return ar.insights(_facts(spark, sf))


# Thresholds of the dependency job: when they hold, advice is due.
GRAPH_ADVICE = [
    ("coupling", ">", 10.0, "High coupling", "high"), ("coupling", ">", 2.5, "Moderate coupling", "medium"), ("stability", "<", 0.3, "Low stability", "medium"),
    ("max_dependencies", ">", 15.0, "Too many dependencies", "high"), ("isolated", ">", 0.0, "Isolated modules", "low"),
    ("avg_dependencies", ">=", 1.0, "Connected graph", "low"),
]


@query("J15", f"""WITH {EDGE_SQL}, {DEGREES_SQL}, a AS (SELECT project, CAST(max(out_degree) AS DOUBLE) AS max_dependencies, sum(out_degree) / CAST(count(*) AS DOUBLE) AS avg_dependencies,
 sum(in_degree + out_degree) / CAST(count(*) AS DOUBLE) AS coupling, avg(CASE WHEN in_degree + out_degree > 0 THEN out_degree / CAST(in_degree + out_degree AS DOUBLE) END) AS stability,
 CAST(count(*) FILTER (in_degree = 0 AND out_degree = 0) AS DOUBLE) AS isolated FROM degrees GROUP BY project),
u AS (SELECT project, metric, value FROM a UNPIVOT (value FOR metric IN (max_dependencies, avg_dependencies, coupling, stability, isolated))),
r(metric, op, t, message, priority) AS (VALUES {', '.join(str(x) for x in GRAPH_ADVICE)})
SELECT project, metric, value, message, priority FROM u JOIN r USING (metric) WHERE (op = '>' AND value > t) OR (op = '>=' AND value >= t) OR (op = '<' AND value < t)""")
def graph_advice(spark, sf):
    metrics = gr.coupling_metrics(gr.degrees(*part_graph(spark, sf))).drop("total_modules", "cohesion")
    return ar.advise(metrics, ["project"], spark.createDataFrame(GRAPH_ADVICE, ar.RULE_SCHEMA))
