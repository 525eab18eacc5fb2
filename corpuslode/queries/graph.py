"""Import graph queries over the code corpus and over a graph derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import GRAPH_EXCLUDE, GRAPH_INCLUDE, glob_filter, glob_regex
from ..operators import facts, graph as gr, ranking as rk
from ..session import cut
from .corpus import code_files, corpus_ctes, quoted, table
from .registry import query

# The graph: five projects; roots, self loops, two-cycles, long cycles, duplicates, hubs.
EDGE_SQL = """
n AS (SELECT p_partkey % 5 AS project, CAST(floor(p_partkey / 5) AS BIGINT) AS v, m FROM part, (SELECT CAST(floor(count(*) / 5) AS BIGINT) AS m FROM part) c),
edges AS (
  SELECT project, v AS src, (v * 3 + 1) % m AS dst, 'a' AS type FROM n
  UNION ALL SELECT project, v, CAST(floor(v / 2) AS BIGINT), 'b' FROM n WHERE v % 3 = 0
  UNION ALL SELECT project, v, (v * 3 + 1) % m, 'dup' FROM n WHERE v % 11 = 0
  UNION ALL SELECT project, v, 7, 'hub' FROM n WHERE v % 20 = 3
  UNION ALL SELECT project, 5, v, 'fan' FROM n WHERE v < 12
  UNION ALL SELECT project, v, v, 'self' FROM n WHERE v % 97 = 0
  UNION ALL SELECT project, v, v + 1, 'pair' FROM n WHERE v % 50 = 10 AND v + 1 < m
  UNION ALL SELECT project, v + 1, v, 'pair' FROM n WHERE v % 50 = 10 AND v + 1 < m
  UNION ALL SELECT project, m + v, v, 'root' FROM n WHERE v < 5),
nodes AS (SELECT DISTINCT project, id FROM (SELECT project, src AS id FROM edges UNION ALL SELECT project, dst FROM edges
          UNION ALL SELECT project, m + 100 + v FROM n WHERE v < 3))"""

DEGREES_SQL = """
degrees AS (
  SELECT nodes.project, id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree,
         (coalesce(i, 0) + coalesce(o, 0)) / CAST(count(*) OVER (PARTITION BY nodes.project) AS DOUBLE) AS centrality
  FROM nodes LEFT JOIN (SELECT project, src AS id, count(*) AS o FROM edges GROUP BY ALL) USING (project, id)
             LEFT JOIN (SELECT project, dst AS id, count(*) AS i FROM edges GROUP BY ALL) USING (project, id))"""

REACH_SQL = """
links AS MATERIALIZED (SELECT DISTINCT project, src, dst FROM edges WHERE src <> dst),
reach(project, a, b) AS (SELECT project, src, dst FROM links UNION SELECT r.project, a, dst FROM reach r JOIN links l ON r.project = l.project AND b = src),
scc AS MATERIALIZED (SELECT r.project, r.a AS id, least(r.a, min(r.b)) AS component, count(*) AS size
        FROM reach r JOIN reach q ON r.project = q.project AND r.a = q.b AND r.b = q.a GROUP BY r.project, r.a)"""

# The longest cycles that are listed one by one.
CYCLE_LENGTH = 4


def part_graph(spark, sf):
    """Nodes and edges derived from the ``part`` table, partitioned for joins on a node."""
    part = table(spark, sf, "part")
    m = F.lit(part.count() // 5)  # one number, from the file footers
    n = part.select((F.col("p_partkey") % 5).alias("project"), F.floor(F.col("p_partkey") / 5).alias("v"))
    v = F.col("v")
    chain = (v * 3 + 1) % m

    def edge(src, dst, kind, when):
        return F.when(when, F.struct(src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), F.lit(kind).alias("type")))

    pair = (v % 50 == 10) & (v + 1 < m)
    found = F.array_compact(F.array(
        edge(v, chain, "a", F.lit(True)), edge(v, F.floor(v / 2), "b", v % 3 == 0), edge(v, chain, "dup", v % 11 == 0),
        edge(v, F.lit(7), "hub", v % 20 == 3), edge(F.lit(5), v, "fan", v < 12), edge(v, v, "self", v % 97 == 0),
        edge(v, v + 1, "pair", pair), edge(v + 1, v, "pair", pair), edge(m + v, v, "root", v < 5),
    ))
    edges = n.select("project", F.explode(found).alias("e")).select("project", "e.*")
    lonely = n.filter("v < 3").select("project", (m + 100 + v).alias("id"))
    nodes = edges.select("project", F.explode(F.array("src", "dst")).alias("id")).unionByName(lonely).distinct()
    return nodes, edges


def _graph_files(spark, sf):
    return glob_filter(code_files(spark, sf), GRAPH_INCLUDE, GRAPH_EXCLUDE)


def graph_file_ctes() -> str:
    return f"""{corpus_ctes('imports')},
gfiles AS MATERIALIZED (SELECT * FROM imported WHERE regexp_matches(path, {quoted(glob_regex(GRAPH_INCLUDE))})
           AND NOT regexp_matches(path, {quoted(glob_regex(GRAPH_EXCLUDE))})),
imps AS (SELECT project, path, i - 1 AS position, import_sources[i] AS source, import_specs[i] AS specs,
                regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir
         FROM (SELECT *, unnest(generate_series(1, len(import_sources))) AS i FROM gfiles)),
normal AS (SELECT *, CASE WHEN starts_with(source, './') THEN dir || '/' || source[3:]
                          WHEN starts_with(source, '../') THEN regexp_extract(dir, '^(.*)/[^/]*$', 1) || '/' || source[4:] END AS key FROM imps),
tries AS (SELECT *, key || suffix AS target FROM normal, (VALUES (1,'.ts'),(2,'.tsx'),(3,'.js'),(4,'.jsx'),(5,'.vue'),
            (6,'/index.ts'),(7,'/index.tsx'),(8,'/index.js'),(9,'/index.jsx'),(10,'/index.vue')) s(priority, suffix)),
resolved AS (SELECT t.project, t.path, position, min_by(target, priority) AS target
             FROM tries t JOIN gfiles g ON g.project = t.project AND g.path = t.target GROUP BY ALL)"""


@query("P3 G11", lambda: f"""WITH {corpus_ctes('imports')}
SELECT project, path, CAST(i - 1 AS INT) AS position, import_sources[i] AS source, coalesce(array_to_string(import_specs[i], '|'), '') AS specifiers
FROM (SELECT *, unnest(generate_series(1, len(import_sources))) AS i FROM imported)""")
def import_declarations(spark, sf):
    rows = facts.import_rows(code_files(spark, sf))
    return rows.withColumn("specifiers", F.array_join("specifiers", "|"))


@query("J1 J2 S2 G11 F13", lambda: f"""WITH {graph_file_ctes()}
SELECT i.project, i.path AS src, r.target AS dst, CASE WHEN starts_with(source, '.') THEN 'import' ELSE 'require' END AS type,
       CAST(i.position AS INT) AS position, coalesce(array_to_string(i.specs, '|'), '') AS specifiers
FROM imps i JOIN resolved r USING (project, path, position)""")
def import_graph_edges(spark, sf):
    edges = gr.import_edges(_graph_files(spark, sf))
    return edges.withColumn("specifiers", F.array_join("specifiers", "|"))


@query("J1 J2", lambda: f"""WITH {graph_file_ctes()}
SELECT project, CASE WHEN NOT (starts_with(source, '.') OR starts_with(source, '/')) THEN 'external' WHEN r.target IS NULL THEN 'unresolved' ELSE 'resolved' END AS state,
  count(*) AS imports, count(DISTINCT source) AS sources
FROM imps i LEFT JOIN resolved r USING (project, path, position) GROUP BY ALL""")
def import_resolution_states(spark, sf):
    state = F.when(F.col("external"), "external").when(F.col("target").isNull(), "unresolved").otherwise("resolved")
    rows = gr.resolve_imports(_graph_files(spark, sf)).groupBy("project", state.alias("state"), "source").count()
    return rows.groupBy("project", "state").agg(F.sum("count").alias("imports"), F.count(F.lit(1)).alias("sources"))


@query("G1 G2", f"WITH {EDGE_SQL}, {DEGREES_SQL} SELECT * FROM degrees")
def graph_degrees(spark, sf):
    return gr.degrees(*part_graph(spark, sf))


@query("G6 G9", f"""WITH {EDGE_SQL}, {DEGREES_SQL}
SELECT project, count(*) AS total_modules, sum(out_degree) / CAST(count(*) AS DOUBLE) AS avg_dependencies, max(out_degree) AS max_dependencies,
  sum(in_degree + out_degree) / CAST(count(*) AS DOUBLE) AS coupling,
  CASE WHEN sum(out_degree) > 0 THEN count(*) / CAST(sum(out_degree) AS DOUBLE) ELSE 1.0 END AS cohesion,
  avg(CASE WHEN in_degree + out_degree > 0 THEN out_degree / CAST(in_degree + out_degree AS DOUBLE) END) AS stability,
  count(*) FILTER (in_degree = 0 AND out_degree = 0) AS isolated FROM degrees GROUP BY project""")
def graph_coupling(spark, sf):
    return gr.coupling_metrics(gr.degrees(*part_graph(spark, sf)))


@query("G7 J11", f"""WITH {EDGE_SQL}, {DEGREES_SQL}
SELECT d.*, kind FROM degrees d, (VALUES ('hub'), ('bottleneck'), ('god-object')) k(kind)
WHERE (kind = 'hub' AND in_degree >= 5) OR (kind = 'bottleneck' AND out_degree >= 10) OR (kind = 'god-object' AND in_degree >= 5 AND out_degree >= 10)""")
def graph_hotspots(spark, sf):
    return gr.hotspots(gr.degrees(*part_graph(spark, sf)))


@query("J11", f"""WITH {EDGE_SQL}, {DEGREES_SQL} SELECT project, id, in_degree, out_degree, in_degree >= 5 OR out_degree >= 10 AS hotspot FROM degrees""")
def graph_hotspot_nodes(spark, sf):
    """All nodes, hotspots flagged."""
    return gr.flag_hotspots(gr.degrees(*part_graph(spark, sf))).select("project", "id", "in_degree", "out_degree", "hotspot")


@query("G10 J10", f"""WITH {EDGE_SQL}, {DEGREES_SQL},
best AS (SELECT project, id FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY centrality DESC, id) AS r FROM degrees) WHERE r <= 50),
ind AS (SELECT e.* FROM edges e SEMI JOIN best b ON b.project = e.project AND b.id = e.src),
ind2 AS (SELECT e.* FROM ind e SEMI JOIN best b ON b.project = e.project AND b.id = e.dst)
SELECT project, src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY src, dst, type) AS r FROM ind2) WHERE r <= 100""")
def graph_important_edges(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return gr.important_subgraph(nodes, edges)[1].select("project", "src", "dst", "type")


@query("G3", f"""WITH RECURSIVE {EDGE_SQL},
und AS (SELECT DISTINCT project, src AS a, dst AS b FROM edges UNION SELECT project, dst, src FROM edges),
f AS (SELECT project, min(id) AS id FROM nodes WHERE contains(CAST(id AS VARCHAR), '77') GROUP BY project),
walk(project, id, depth) AS (SELECT project, id, 0 FROM f UNION SELECT w.project, b, depth + 1 FROM walk w JOIN und u ON u.project = w.project AND u.a = w.id WHERE depth < 3)
SELECT project, id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY project, id""")
def graph_neighbourhood(spark, sf):
    """Nodes within three undirected steps of each project's first node named like '77'."""
    nodes, edges = part_graph(spark, sf)
    start = nodes.filter(F.col("id").cast("string").contains("77")).groupBy("project").agg(F.min("id").alias("id"))
    return gr.neighbourhood(nodes, edges, start, max_depth=3)


@query("G5", f"WITH RECURSIVE {EDGE_SQL}, {REACH_SQL} SELECT project, id, component FROM scc")
def graph_components(spark, sf):
    _, edges = part_graph(spark, sf)
    return gr.strong_components(edges)


@query("G4 U5", f"""WITH RECURSIVE {EDGE_SQL}, {REACH_SQL},
comp AS MATERIALIZED (SELECT project, component, count(*) AS members FROM scc GROUP BY ALL HAVING count(*) > 2),
inner_links AS MATERIALIZED (SELECT l.project, s.component, l.src, l.dst FROM links l JOIN scc s ON s.project = l.project AND s.id = l.src
                JOIN scc t ON t.project = l.project AND t.id = l.dst AND t.component = s.component JOIN comp c ON c.project = l.project AND c.component = s.component),
walk(project, component, id, depth) AS (
  SELECT project, component, component, 0 FROM comp
  UNION SELECT w.project, w.component, i.dst, depth + 1 FROM walk w JOIN inner_links i ON i.project = w.project AND i.component = w.component AND i.src = w.id
  WHERE depth < 40 AND NOT (w.id = w.component AND depth > 0)),
closing AS (SELECT project, component, min(depth) AS length FROM walk WHERE id = component AND depth > 0 GROUP BY ALL)
SELECT project, src AS first, 1 AS length, 'critical' AS severity FROM (SELECT DISTINCT project, src FROM edges WHERE src = dst)
UNION ALL SELECT a.project, a.src, 2, 'critical' FROM links a JOIN links b ON a.project = b.project AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst
UNION ALL SELECT project, component, CAST(length AS INT), 'warning' FROM closing WHERE length > 2""")
def graph_cycles(spark, sf):
    _, edges = part_graph(spark, sf)
    found = gr.cycles(edges)
    return found.select("project", F.element_at("cycle", 1).alias("first"), "length", "severity")


@query("G4", f"""WITH RECURSIVE {EDGE_SQL}, {REACH_SQL},
sizes AS (SELECT project, component, count(*) AS members FROM scc GROUP BY ALL),
walk(project, path, id) AS (
  SELECT project, [src, dst], dst FROM links WHERE src < dst
  UNION ALL SELECT w.project, list_append(path, l.dst), l.dst FROM walk w JOIN links l ON l.project = w.project AND l.src = w.id
  WHERE l.dst > path[1] AND NOT list_contains(path, l.dst) AND len(path) < {CYCLE_LENGTH}),
closed AS (SELECT w.project, path[1] AS first, list_append(path, l.dst) AS cycle FROM walk w JOIN links l ON l.project = w.project AND l.src = w.id AND l.dst = path[1]
  UNION ALL SELECT DISTINCT project, src, [src, dst] FROM edges WHERE src = dst)
SELECT c.project, coalesce(s.component, first) AS component, coalesce(members, 1) AS members, array_to_string(cycle, ' ') AS cycle, CAST(len(cycle) - 1 AS INT) AS length
FROM closed c LEFT JOIN scc s ON s.project = c.project AND s.id = c.first LEFT JOIN sizes z ON z.project = c.project AND z.component = s.component""")
def graph_simple_cycles(spark, sf):
    """All cycles of a few files, each once, with the size of the component they lie in."""
    _, edges = part_graph(spark, sf)
    return gr.simple_cycles(edges, CYCLE_LENGTH).withColumn("cycle", F.array_join(F.transform("cycle", lambda i: i.cast("string")), " "))


@query("G8", f"""WITH RECURSIVE {EDGE_SQL}, {DEGREES_SQL},
links AS (SELECT DISTINCT project, src, dst FROM edges WHERE src <> dst),
walk(project, root, id, depth) AS (SELECT project, id, id, 0 FROM degrees WHERE in_degree = 0
  UNION SELECT w.project, root, dst, depth + 1 FROM walk w JOIN links l ON l.project = w.project AND l.src = w.id WHERE depth < 60),
dist AS (SELECT project, root, id, min(depth) AS d FROM walk GROUP BY ALL),
far AS (SELECT project, root, max(d) AS far FROM dist GROUP BY ALL)
SELECT project, avg(far) AS avg_depth, count(*) AS roots FROM far GROUP BY project""")
def graph_average_depth(spark, sf):
    return gr.average_depth(*part_graph(spark, sf))


@query("G12 J11", f"""WITH RECURSIVE {EDGE_SQL}, {REACH_SQL}
SELECT e.project, e.src, e.dst, e.type, e.src = e.dst OR coalesce(s.component = t.component, false) AS circular
FROM edges e LEFT JOIN scc s ON s.project = e.project AND s.id = e.src LEFT JOIN scc t ON t.project = e.project AND t.id = e.dst""")
def graph_critical_edges(spark, sf):
    """Edges that lie on some cycle, of any length."""
    _, edges = part_graph(spark, sf)
    return gr.circular_edges(edges, gr.strong_components(edges)).select("project", "src", "dst", "type", "circular")


@query("W6 W7 W8", f"""WITH {EDGE_SQL}, {DEGREES_SQL},
h AS (SELECT d.*, kind FROM degrees d, (VALUES ('hub'), ('bottleneck')) k(kind)
      WHERE (kind = 'hub' AND in_degree >= 5) OR (kind = 'bottleneck' AND out_degree >= 10)),
r AS (SELECT *, row_number() OVER (PARTITION BY project, kind ORDER BY -centrality, id) AS rank, count(*) OVER (PARTITION BY project, kind) AS total_items FROM h)
SELECT project, kind, id, CAST(rank AS INT) AS rank, total_items, CAST(ceil(total_items / 4.0) AS INT) AS total_pages,
       CAST(least(2, greatest(1, ceil(total_items / 4.0))) AS INT) AS current_page
FROM r WHERE rank > (least(2, ceil(total_items / 4.0)) - 1) * 4 AND rank <= least(2, ceil(total_items / 4.0)) * 4""")
def hotspot_pages(spark, sf):
    """Second page of four (or the last page) of each hotspot collection of each project."""
    hot = gr.hotspots(gr.degrees(*part_graph(spark, sf))).filter("kind <> 'god-object'")
    hot = hot.withColumn("order", -F.col("centrality"))
    page = rk.paged(hot, ["project", "kind"], ["order", "id"], page=2, size=4)
    return page.select("project", "kind", "id", "rank", "total_items", "total_pages", "current_page")
