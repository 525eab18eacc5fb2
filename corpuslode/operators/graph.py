"""Import graphs: edge building, degrees, coupling, hotspots, neighbourhoods, cycles, depth.

A graph is two tables: nodes ``(project, id)`` and edges ``(project, src, dst, ...)``.
Edges form a multigraph.  Iterative operators shuffle only their frontier or labels,
cut lineage every round, and stop when nothing changes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import paths
from ..functions.components import component_of, least_cycles
from ..functions.distances import farthest_nodes
from ..session import cut, stored
from .facts import import_rows
from .ranking import ordered_rank, top_k

# Extensions tried for an import, in order.
IMPORT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".vue"]

# Hotspot thresholds and size limits of the reduced graph.
HUB_IN, BOTTLENECK_OUT = 5, 10
NODE_LIMIT, EDGE_LIMIT = 50, 100

# Hops of an iterative operator that share one plan before its rows are written.
HOPS = 4

# Merging of nodes goes on while a pair of steps leaves less than this share of the links.
SHRUNK = 0.9

# Links of a project that a task takes, links times roots of a part of its roots, and parts of a project.
TASK_LINKS = 1 << 21
TASK_WORK = 1 << 26
TASK_PARTS = 64


def import_targets(files: DataFrame) -> DataFrame:
    """What an import may name: ``(project, key, target)``, one target per key.

    ``a/b`` names ``a/b.ts`` before ``a/b.tsx`` ... before ``a/b/index.ts``.  The
    choice is made once per file set, so resolving is one equi join per import.
    """
    ext = F.array_position(F.array(*[F.lit(e) for e in IMPORT_EXTENSIONS]), paths.extname(F.col("path")))
    path = F.col("path")
    bare = F.substr(path, F.lit(1), F.length(path) - F.length(paths.extname(path)))
    named = F.struct(bare.alias("key"), ext.alias("priority"))
    index = F.struct(paths.dirname(path).alias("key"), (ext + len(IMPORT_EXTENSIONS)).alias("priority"))
    choices = F.when(paths.stem(path) == "index", F.array(named, index)).otherwise(F.array(named))
    return (
        files.select("project", "path", ext.alias("ext"), F.explode(choices).alias("c"))
        .filter(F.col("ext") > 0)
        .groupBy("project", F.col("c.key").alias("key"))
        .agg(F.min(F.struct(F.col("c.priority").alias("priority"), F.col("path"))).alias("best"))
        .select("project", "key", F.col("best.path").alias("target"))
    )


def resolve_imports(files: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Every import with the file it names; ``target`` is null when there is none."""
    imports = import_rows(files) if imports is None else imports
    source = F.col("source")
    joined = F.when(source.startswith("/"), source).otherwise(F.concat(paths.dirname(F.col("path")), F.lit("/"), source))
    local = source.startswith(".") | source.startswith("/")
    # Packages cannot match a file; keeping them out of the join keeps their null keys off one task.
    inside = imports.filter(local).withColumn("external", F.lit(False)).withColumn("key", paths.normalize_path(joined))
    found = inside.join(import_targets(files), ["project", "key"], "left").drop("key")
    outside = imports.filter(~local).withColumn("external", F.lit(True)).withColumn("target", F.lit(None).cast("string"))
    return found.unionByName(outside)


def import_edges(files: DataFrame, include_external: bool = False) -> DataFrame:
    """Edges between files; with ``include_external`` packages are targets too."""
    resolved = resolve_imports(files)
    if not include_external:
        resolved = resolved.filter("NOT external")
    target = F.coalesce("target", F.when(F.col("external"), F.col("source"))) if include_external else F.col("target")
    return resolved.withColumn("dst", target).filter("dst IS NOT NULL").select(
        "project",
        F.col("path").alias("src"),
        "dst",
        F.when(F.col("source").startswith("."), "import").otherwise("require").alias("type"),
        "position",
        "specifiers",
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree (multi-edges count each time) and centrality of every node."""
    ends = edges.select("project", F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )).alias("e"))
    counts = ends.groupBy("project", F.col("e.id").alias("id")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree")
    )
    sizes = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("total"))
    return (
        nodes.select("project", "id").join(counts, ["project", "id"], "left").na.fill(0, ["in_degree", "out_degree"])
        .join(sizes, "project")
        .withColumn("centrality", (F.col("in_degree") + F.col("out_degree")) / F.col("total"))
        .drop("total")
    )


def coupling_metrics(measured: DataFrame) -> DataFrame:
    """One row per project from node degrees."""
    ins, outs = F.col("in_degree"), F.col("out_degree")
    average = F.sum(outs) / F.count(F.lit(1))
    return measured.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_modules"),
        average.alias("avg_dependencies"),
        F.max(outs).alias("max_dependencies"),
        (F.sum(ins + outs) / F.count(F.lit(1))).alias("coupling"),
        F.when(average > 0, F.lit(1.0) / average).otherwise(1.0).alias("cohesion"),
        F.coalesce(F.avg(F.when(ins + outs > 0, outs / (ins + outs))), F.lit(0.0)).alias("stability"),
        F.count_if((ins == 0) & (outs == 0)).alias("isolated"),
    )


def hotspots(measured: DataFrame) -> DataFrame:
    """Hubs, bottlenecks and god objects; a god object gives all three rows."""
    hub, neck = F.col("in_degree") >= HUB_IN, F.col("out_degree") >= BOTTLENECK_OUT
    kinds = F.array_compact(F.array(
        F.when(hub, F.lit("hub")), F.when(neck, F.lit("bottleneck")), F.when(hub & neck, F.lit("god-object"))
    ))
    return measured.withColumn("kind", F.explode(kinds))


def flag_hotspots(measured: DataFrame) -> DataFrame:
    """Every node with ``hotspot``: whether it is of any of the kinds."""
    return measured.withColumn("hotspot", (F.col("in_degree") >= HUB_IN) | (F.col("out_degree") >= BOTTLENECK_OUT))


def important_subgraph(nodes: DataFrame, edges: DataFrame, node_limit: int = NODE_LIMIT,
                       edge_limit: int = EDGE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of large projects cut to the most central ones; small ones whole."""
    measured = degrees(nodes, edges)
    n = nodes.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy("project").agg(F.count(F.lit(1)).alias("m"))
    large = n.join(m, "project", "left").filter((F.col("n") > node_limit) | (F.coalesce("m", F.lit(0)) > edge_limit)).select("project")
    best = top_k(measured.join(large, "project", "left_semi"), ["project"], [F.desc("centrality"), F.col("id")], node_limit)
    small = measured.join(large, "project", "left_anti").withColumn("rank", F.lit(None).cast("int"))
    kept = best.unionByName(small)
    inside = induced(edges.join(large, "project", "left_semi"), best)
    inside = top_k(inside, ["project"], [F.col("src"), F.col("dst"), F.col("type")], edge_limit).drop("rank")
    return kept, inside.unionByName(edges.join(large, "project", "left_anti"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    left = nodes.select("project", F.col("id").alias("src")).distinct()
    right = nodes.select("project", F.col("id").alias("dst")).distinct()
    return edges.join(left, ["project", "src"], "left_semi").join(right, ["project", "dst"], "left_semi")


def focus_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Per project the first node whose id contains ``text``."""
    return nodes.filter(F.col("id").contains(text)).groupBy("project").agg(F.min("id").alias("id"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes within ``max_depth`` undirected steps of each project's start node.

    Projects without a start node keep their whole graph, at depth null.
    """
    pairs = edges.select("project", F.explode(F.array(
        F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.col("dst").alias("a"), F.col("src").alias("b")),
    )).alias("p")).select("project", F.col("p.a").alias("id"), F.col("p.b").alias("next"))
    pairs = pairs.join(start.select("project"), "project", "left_semi").filter("id <> next").distinct()
    reached = _spread(start.select("project", "id"), ["project"], pairs, max_depth)
    whole = nodes.join(start, "project", "left_anti").select("project", "id", F.lit(None).cast("int").alias("depth"))
    return reached.unionByName(whole)


def _spread(start: DataFrame, origin: Sequence[str], pairs: DataFrame, max_depth: int | None) -> DataFrame:
    """Breadth-first distances; ``origin`` names the search each row belongs to.

    A few hops share one plan; then the new nodes are written and the search
    goes on from the outermost of them.
    """
    pairs = cut(pairs)
    keys = [*origin, "id"]
    frontier = cut(start.withColumn("depth", F.lit(0)))
    rounds = [frontier]
    depth = 0
    stay = F.struct("id", "depth")
    go = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("id"), (F.col("depth") + 1).alias("depth")))
    step = F.explode(F.array_compact(F.array(stay, go))).alias("n")
    there, nearest = F.col("n.id").alias("id"), F.min("n.depth").alias("depth")
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        hops = HOPS if max_depth is None else min(HOPS, max_depth - depth)
        wave = frontier
        for _ in range(hops):
            wave = wave.join(pairs, ["project", "id"], "left").select(*origin, step).groupBy(*origin, there).agg(nearest)
        fresh = cut(wave.join(_merge(rounds), keys, "left_anti"))
        depth += hops
        rounds.append(fresh)
        frontier = fresh.filter(F.col("depth") == depth)
    return _merge(rounds)


def _merge(rounds: list[DataFrame]) -> DataFrame:
    """All rounds as one table; every sixteen are written together to keep plans short."""
    if len(rounds) >= 16:
        together = rounds[0]
        for part in rounds[1:]:
            together = together.unionByName(part)
        rounds[:] = [cut(together.coalesce(together.sparkSession.sparkContext.defaultParallelism))]
    out = rounds[0]
    for part in rounds[1:]:
        out = out.unionByName(part)
    return out


def farthest(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(project, root, far)``: distance from each of ``roots (project, root)`` to the farthest node it reaches.

    All searches of a project work on the same links.  A project with up to
    ``TASK_LINKS`` of them sends its links to several tasks, each with a part of
    its roots, so the rounds do not grow with the length of a path.  A larger one
    is searched in waves over the whole table.
    """
    asked, pairs = stored(roots.select("project", "root").distinct()), stored(pairs.select("project", "id", "next").distinct())
    links = pairs.groupBy("project").agg(F.count(F.lit(1)).alias("links"))
    work = F.col("links") * F.col("roots")
    plan = stored(asked.groupBy("project").agg(F.count(F.lit(1)).alias("roots")).join(links, "project").select(
        "project", F.least(F.lit(TASK_PARTS), F.ceil(work / TASK_WORK)).cast("int").alias("parts"), (F.col("links") > TASK_LINKS).alias("large")))
    total = plan.filter("NOT large").agg(F.sum("parts")).first()[0]
    large = plan.filter("large").select("project")
    found = []
    if total is not None:
        # Several times as many partitions as groups, so that few groups share a task.
        deal = lambda df: df.repartition(4 * min(total, 1000), "project", "part")
        small = plan.filter("NOT large").select("project", "parts")
        dealt = deal(asked.join(small, "project").withColumn("part", F.pmod(F.xxhash64("root"), "parts").cast("int")).drop("parts"))
        given = deal(pairs.join(small, "project").filter("id IS NOT NULL").select("project", "id", "next", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
        schema = StructType([*asked.schema.fields, StructField("far", IntegerType())])
        found.append(dealt.groupBy("project", "part").cogroup(given.groupBy("project", "part")).applyInArrow(_farthest_of_group, schema))
    if not large.isEmpty():
        found.append(_farthest_in_waves(asked.join(large, "project"), pairs.join(large, "project")))
    if not found:
        return asked.withColumn("far", F.lit(0))
    # A project or root that is null, or a root without links, reaches nothing.
    return asked.join(_merge(found), ["project", "root"], "left").na.fill(0, ["far"])


def _farthest_of_group(roots: pa.Table, links: pa.Table) -> pa.Table:
    """Part of a project's roots with the project's links."""
    if not roots.num_rows:
        return roots.select(["project", "root"]).append_column("far", pa.array([], pa.int32()))
    ids = [roots["root"], links["id"], links["next"]]
    codes = pa.chunked_array([chunk for column in ids for chunk in column.chunks], ids[0].type).combine_chunks().dictionary_encode(null_encoding="encode")
    number = codes.indices.to_numpy()
    sources, src, dst = np.split(number, [len(ids[0]), len(ids[0]) + len(ids[1])])
    far = farthest_nodes(src, dst, len(codes.dictionary), sources)
    return roots.select(["project", "root"]).append_column("far", pa.array(far.astype(np.int32)))


def _farthest_in_waves(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``farthest`` of projects of any size.

    A project's roots are numbered, and one long
    holds which of 64 roots have reached a node, so a wave has at most a row per
    node and 64 roots, joined by bit operations.  A root's distance is the last
    wave that carried its bit to a new node.
    """
    numbered = cut(ordered_rank(roots.select("project", "root").distinct(), ["project"], ["root"], "number"))
    placed = numbered.select("project", "root", F.expr("(number - 1) div 64").alias("word"),
                             F.expr("shiftleft(1L, cast((number - 1) % 64 AS int))").alias("bit"))
    own = pairs.select("project", F.explode(F.array("id", "next")).alias("id")).distinct()
    # A node's own hop keeps its bits in the aggregation that brings the new ones.
    hops = cut(pairs.select("project", "id", "next", F.lit(False).alias("own")).unionByName(
        own.select("project", "id", F.col("id").alias("next"), F.lit(True).alias("own"))))
    state = cut(placed.select("project", F.col("root").alias("id"), "word", F.col("bit").alias("seen"), F.col("bit").alias("fresh")))
    waves = [f"wave{k}" for k in range(HOPS)]
    taken = lambda test, name: F.coalesce(F.bit_or(F.when(test, F.col(name))), F.lit(0).cast("bigint"))
    told, depth = [], 0
    while True:
        for k in range(HOPS):
            mine = F.col("own")
            state = (
                state.join(hops, ["project", "id"]).filter(mine | (F.col("fresh") != 0))
                .groupBy("project", F.col("next").alias("id"), "word")
                .agg(taken(mine, "seen").alias("before"), taken(~mine, "fresh").alias("got"), *[taken(mine, w).alias(w) for w in waves[:k]])
                .withColumn("fresh", F.col("got").bitwiseAND(F.bitwise_not("before")))
                .select("project", "id", "word", F.col("before").bitwiseOR(F.col("got")).alias("seen"), "fresh", *waves[:k], F.col("fresh").alias(waves[k]))
            )
        state = cut(state)
        news = state.groupBy("project", "word").agg(*[F.bit_or(w).alias(w) for w in waves])
        told.append(cut(news.select("project", "word", F.explode(F.array(*[
            F.struct(F.lit(depth + k + 1).alias("depth"), F.col(w).alias("bits")) for k, w in enumerate(waves)])).alias("n")).select(
            "project", "word", "n.*").filter("bits <> 0")))
        depth += HOPS
        if state.filter("fresh <> 0").isEmpty():
            break
        state = state.select("project", "id", "word", "seen", "fresh")
    last = placed.join(_merge(told), ["project", "word"]).filter(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    last = last.groupBy("project", "root").agg(F.max("depth").alias("far"))
    return placed.select("project", "root").join(last, ["project", "root"], "left").na.fill(0, ["far"])


def average_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean over root nodes of the distance to the farthest node they reach.

    A project without roots gives 1.
    """
    measured = degrees(nodes, edges)
    roots = measured.filter("in_degree = 0").select("project", F.col("id").alias("root"))
    pairs = edges.filter("src <> dst").select("project", F.col("src").alias("id"), F.col("dst").alias("next")).distinct()
    far = farthest(roots, pairs)
    means = far.groupBy("project").agg(F.avg("far").alias("avg_depth"), F.count(F.lit(1)).alias("roots"))
    return nodes.select("project").distinct().join(means, "project", "left").na.fill(1.0, ["avg_depth"]).na.fill(0, ["roots"])


def strong_components(edges: DataFrame) -> DataFrame:
    """Strongly connected components with at least two nodes: ``(project, id, component)``.

    A project of up to ``TASK_LINKS`` links is walked in one task, in linear time.
    In a larger one sources and sinks go, and chains and trees are contracted until
    it fits, so the number of rounds does not grow with the length of a cycle; what
    never fits is labelled as a whole (see ``_core_components``).
    Then the contracted nodes get their components back.
    """
    links = stored(edges.filter("src <> dst AND project IS NOT NULL").select("project", "src", "dst").distinct())
    small, large = _by_size(links)
    found = _components_in_tasks(small)
    if large is None:
        return stored(found)
    large, undo = _contract(stored(_trim(large)))
    small, large = _by_size(large)
    rest = _components_in_tasks(small)
    if large is not None:
        rest = rest.unionByName(_core_components(large))
    for entries in reversed(undo):
        rest = _expanded(stored(rest), entries)
    rest = stored(rest)
    least = rest.groupBy("project", "component").agg(F.min("id").alias("least"))
    return stored(found.unionByName(rest.join(least, ["project", "component"]).select("project", "id", F.col("least").alias("component"))))


def _by_size(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Stored links of the projects that fit a task, and those of the others if there are any."""
    large = stored(links.groupBy("project").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_LINKS).select("project"))
    if large.isEmpty():
        return links, None
    return links.join(large, "project", "left_anti"), links.join(large, "project", "left_semi")


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The different values of all columns in order, and each column by their places."""
    ids = pc.unique(pa.chunked_array([chunk for column in columns for chunk in column.chunks], columns[0].type))
    ids = ids.take(pc.sort_indices(ids))
    return ids, [pc.index_in(column, value_set=ids).to_numpy() for column in columns]


def _components_in_tasks(links: DataFrame) -> DataFrame:
    """Components with at least two nodes of projects whose links fit a task."""
    project, node = links.schema["project"], links.schema["src"].dataType
    schema = StructType([project, StructField("id", node), StructField("component", node)])
    projects = links.select("project").distinct().count()
    # Several times as many partitions as projects, so that few projects share a task.
    dealt = links.repartition(4 * min(max(projects, 1), 1000), "project")
    return dealt.groupBy("project").applyInArrow(_components_of_group, schema)


def _components_of_group(links: pa.Table) -> pa.Table:
    ids, (src, dst) = _numbered(links["src"], links["dst"])
    found = component_of(src, dst, len(ids))
    members = np.flatnonzero(np.bincount(found, minlength=len(ids))[found] > 1)
    project = links["project"].take(pa.array(np.zeros(len(members), np.int64)))
    return pa.table([project, ids.take(pa.array(members)), ids.take(pa.array(found[members]))], ["project", "id", "component"])


def _contract(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Merge nodes into their only successor or only predecessor until every project fits a task, while that shrinks the graph well.

    Every path through a merged node passes the node it merges into, so what
    reaches what stays.  Nodes that merge at the same time never merge into each
    other: a hashed coin decides between neighbours.  Beside the links that stay,
    the entries ``(project, src, id, to)`` of every step are given: ``id`` was merged into ``to``,
    and is on a cycle exactly if one of its entries ``src`` is in the component of ``to``.
    """
    def measured():
        return links.groupBy("project").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    undo: list[DataFrame] = []
    (most, left), before = measured(), None
    while most > TASK_LINKS and (before is None or left < SHRUNK * before):
        before = left
        for forward in (True, False):
            ends = ["src", "dst"] if forward else ["dst", "src"]
            ways = links.select("project", F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst"))
            single = ways.groupBy("project", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")).filter("n = 1").drop("n")
            coin = lambda c: F.xxhash64(c, F.lit(len(undo))).bitwiseAND(F.lit(1).cast("bigint")) == 1
            tossed = single.filter(coin("id"))
            last = tossed.filter(coin("to")).join(single.select("project", F.col("id").alias("to")), ["project", "to"], "left_anti")
            merged = stored(tossed.filter(~coin("to")).unionByName(last))
            undo.append(ways.join(merged, (ways["project"] == merged["project"]) & (ways["dst"] == merged["id"])).select(
                ways["project"], "src", "id", "to"))
            stay = ways.join(merged.select("project", F.col("id").alias("src")), ["project", "src"], "left_anti")
            stay = stay.join(merged.select("project", F.col("id").alias("dst"), "to"), ["project", "dst"], "left").select(
                "project", "src", F.coalesce("to", "dst").alias("dst")).filter("src <> dst").distinct()
            links = stored(_trim(stay.select("project", F.col(ends[0]).alias("src"), F.col(ends[1]).alias("dst")), 1))
        most, left = measured()
    return links, undo


def _expanded(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Components of the graph before one step of merging from those after it; a node without a row is alone."""
    def labelled(end):
        return found.select("project", F.col("id").alias(end), F.col("component").alias(f"of_{end}"))

    held = entries.join(labelled("src"), ["project", "src"], "left").join(labelled("to"), ["project", "to"], "left")
    home = F.coalesce("of_to", "to")
    held = held.filter(F.coalesce("of_src", "src") == home)
    alone = F.when(F.col("of_to").isNull(), F.col("to"))
    more = held.select("project", F.explode(F.array_compact(F.array("id", alone))).alias("id"), home.alias("component")).distinct()
    return found.unionByName(more)


def _core_components(links: DataFrame) -> DataFrame:
    """Components with at least two nodes of links between different nodes.

    Each node learns the least id that reaches it and the least id it reaches.
    Equal labels settle a component; edges between different label pairs cannot
    lie in one and are dropped.  Every round settles at least the least open
    node of every connected part.
    """
    none = links.select("project", F.col("src").alias("id"), F.col("src").alias("component")).filter(F.lit(False))
    settled: list[DataFrame] = []
    while True:
        links = cut(_trim(links))
        if links.isEmpty():
            break
        labels = _least_labels(links)
        settled.append(labels.filter("f = b").select("project", "id", F.col("f").alias("component")))
        open_nodes = labels.filter("f <> b")
        left = open_nodes.select("project", F.col("id").alias("src"), F.col("f").alias("fs"), F.col("b").alias("bs"))
        right = open_nodes.select("project", F.col("id").alias("dst"), F.col("f").alias("fd"), F.col("b").alias("bd"))
        links = (
            links.join(left, ["project", "src"]).join(right, ["project", "dst"])
            .filter("fs = fd AND bs = bd").select("project", "src", "dst")
        )
    if not settled:
        return none
    found = _merge(settled)
    several = found.groupBy("project", "component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(several, ["project", "component"], "left_semi").select("project", "id", "component")


def _trim(links: DataFrame, rounds: int = 2) -> DataFrame:
    """Drop edges out of sources and into sinks; most import graphs shrink at once."""
    for _ in range(rounds):
        heads = links.select("project", F.col("dst").alias("src")).distinct()
        tails = links.select("project", F.col("src").alias("dst")).distinct()
        links = links.join(heads, ["project", "src"], "left_semi").join(tails, ["project", "dst"], "left_semi")
    return links


def _least_labels(links: DataFrame) -> DataFrame:
    """Least id that reaches each node and least id it reaches, as ``f`` and ``b``.

    A self hop keeps a node's own labels in the same aggregation, so a hop is one
    join and one grouping on the node, which share a partitioning.
    """
    hops = cut(links.select("project", F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit("on").alias("way")),
        F.struct(F.col("dst").alias("id"), F.col("src").alias("to"), F.lit("back").alias("way")),
        F.struct(F.col("src").alias("id"), F.col("src").alias("to"), F.lit("self").alias("way")),
        F.struct(F.col("dst").alias("id"), F.col("dst").alias("to"), F.lit("self").alias("way")),
    )).alias("h")).select("project", "h.*").distinct())
    own, f, b = F.col("way") == "self", F.col("f"), F.col("b")
    told = [
        F.min(F.when(F.col("way") != "back", f)).alias("f"), F.min(F.when(F.col("way") != "on", b)).alias("b"),
        F.min(F.when(own, f)).alias("f0"), F.min(F.when(own, b)).alias("b0"),
        F.max(F.when(own, F.col("changed"))).alias("changed"),
    ]
    keep = ["project", F.col("to").alias("id"), "f", "b", (F.col("changed") | (f < F.col("f0")) | (b < F.col("b0"))).alias("changed")]
    labels = hops.filter(own).selectExpr("project", "id", "id AS f", "id AS b")
    while True:
        moved = labels.withColumn("changed", F.lit(False))
        for _ in range(HOPS):
            moved = hops.join(moved, ["project", "id"]).groupBy("project", "to").agg(*told).select(*keep)
        moved = cut(moved)
        labels = moved.select("project", "id", "f", "b")
        if moved.filter("changed").isEmpty():
            return labels


def cycles(edges: DataFrame) -> DataFrame:
    """Circular imports: self loops, two-file cycles, and one shortest witness per component.

    The number of simple cycles grows exponentially, and a depth-first search
    lists an order-dependent part of them.  Here every circular file is covered:
    all cycles of one or two files (critical), and for each larger component the
    shortest cycle through its least file (warning).
    """
    links = stored(edges.select("project", "src", "dst").distinct())
    loops = links.filter("src = dst").select("project", F.array("src", "dst").alias("cycle"))
    there = links.filter("src < dst")
    back = links.filter("src > dst").select("project", F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = there.join(back, ["project", "src", "dst"], "left_semi").select("project", F.array("src", "dst", "src").alias("cycle"))
    long = witness_cycles(links).filter(F.size("cycle") > 3)
    found = loops.unionByName(pairs).unionByName(long)
    return found.withColumn("length", F.size("cycle") - 1).withColumn(
        "severity", F.when(F.size("cycle") <= 3, "critical").otherwise("warning")
    )


def simple_cycles(edges: DataFrame, longest: int) -> DataFrame:
    """Every simple cycle of up to ``longest`` files, once: ``(project, component, members, cycle, length)``.

    A cycle is written from its least file on and ends with it again.  Paths start
    at every file of a strong component and grow by larger files of the same
    component, so a cycle is found from its least file alone; a path that no
    further file can close is dropped.  ``members`` is the size of the component.
    The number of cycles grows exponentially with ``longest``, which has no default.
    """
    links = stored(edges.select("project", "src", "dst").distinct())
    parts = strong_components(links)
    sizes = parts.groupBy("project", "component").agg(F.count(F.lit(1)).alias("members"))
    inner = cut(
        links.filter("src <> dst")
        .join(parts.select("project", F.col("id").alias("src"), "component"), ["project", "src"])
        .join(parts.select("project", F.col("id").alias("dst"), F.col("component").alias("other")), ["project", "dst"])
        .filter("component = other").select("project", "component", F.col("src").alias("id"), F.col("dst").alias("next"))
    )
    keys, home = ["project", "component", "id"], F.col("path")[0]
    paths = inner.filter("id < next").select("project", "component", F.array("id", "next").alias("path"), F.col("next").alias("id"))
    found = []
    for length in range(2, longest + 1):
        paths = cut(paths)
        met = paths.join(inner, keys)
        found.append(met.filter(F.col("next") == home).select("project", "component", F.array_append("path", F.col("next")).alias("cycle")))
        if length == longest or paths.isEmpty():
            break
        onward = (F.col("next") > home) & ~F.array_contains("path", F.col("next"))
        paths = met.filter(onward).select("project", "component", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("id"))
    loops = links.filter("src = dst").select("project", F.col("src").alias("component"), F.array("src", "dst").alias("cycle"))
    loops = loops.join(parts.select("project", F.col("id").alias("component"), F.col("component").alias("whole")), ["project", "component"], "left").select(
        "project", F.coalesce("whole", "component").alias("component"), "cycle")
    several = _merge([loops, *found]) if longest > 0 else loops.limit(0)
    return several.join(sizes, ["project", "component"], "left").select(
        "project", "component", F.coalesce("members", F.lit(1)).cast("bigint").alias("members"), "cycle", (F.size("cycle") - 1).alias("length"))


def witness_cycles(links: DataFrame) -> DataFrame:
    """Shortest cycle through the least node of each component of three or more nodes.

    Of several the first by its nodes.  Components are dealt to tasks of about
    ``TASK_LINKS`` links; a larger one is walked as a whole (see ``_walked_cycles``).
    """
    keys = ["project", "component"]
    parts = strong_components(links)
    big = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).filter("size > 2").drop("size")
    members = parts.join(big, keys, "left_semi")
    inner = stored(
        links.filter("src <> dst")
        .join(members.select("project", F.col("id").alias("src"), "component"), ["project", "src"])
        .join(members.select("project", F.col("id").alias("dst"), F.col("component").alias("c2")), ["project", "dst"])
        .filter("component = c2").select("project", "component", F.col("src").alias("id"), F.col("dst").alias("next"))
    )
    sizes = stored(inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    large = sizes.filter(F.col("n") > TASK_LINKS).drop("n")
    fits = sizes.filter(F.col("n") <= TASK_LINKS)
    plan = stored(fits.groupBy("project").agg(F.ceil(F.sum("n") / TASK_LINKS).cast("int").alias("parts")))
    total = plan.agg(F.sum("parts")).first()[0] or 1
    dealt = inner.join(fits.select(*keys), keys, "left_semi").join(plan, "project").withColumn("part", F.pmod(F.xxhash64("component"), "parts").cast("int")).drop("parts")
    schema = StructType([inner.schema["project"], StructField("cycle", ArrayType(inner.schema["id"].dataType))])
    # Several times as many partitions as groups, so that few groups share a task.
    found = dealt.repartition(4 * min(total, 1000), "project", "part").groupBy("project", "part").applyInArrow(_witnesses_of_group, schema)
    if large.isEmpty():
        return found
    return found.unionByName(_walked_cycles(inner.join(large, keys, "left_semi"), large))


def _witnesses_of_group(links: pa.Table) -> pa.Table:
    """Witness cycles of some components of a project."""
    ids, (src, dst, homes) = _numbered(links["id"], links["next"], links["component"].cast(links["id"].type))
    found = [cycle for cycle in least_cycles(src, dst, len(ids), np.unique(homes)) if cycle]
    ends = np.cumsum([0, *map(len, found)])
    nodes = ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)))
    cycles = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), nodes).cast(pa.list_(nodes.type))
    return pa.table([links["project"].take(pa.array(np.zeros(len(found), np.int64))), cycles], ["project", "cycle"])


def _walked_cycles(inner: DataFrame, big: DataFrame) -> DataFrame:
    """``witness_cycles`` of components ``big (project, component)`` of any size, by walks over their whole table."""
    keys = ["project", "component"]
    # A walk from home takes a whole chain in one hop, so the best walk to a node may come late; it goes on while one gets better.
    hops = cut(_chained(inner).select("project", "component", "id", "next", "way"))
    closing = F.col("next") == F.col("component")
    walked = F.concat("walk", "way")
    stay = F.struct("id", "walk", "closed", F.lit(True).alias("old"))
    go = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("id"), walked.alias("walk"), closing.alias("closed"), F.lit(False).alias("old")))
    step = F.explode(F.array_compact(F.array(stay, go))).alias("n")
    measured = F.struct(F.size("n.walk").alias("length"), F.col("n.walk").alias("walk"))
    told = [F.min(measured).alias("best"), F.min(F.when(F.col("n.old"), measured)).alias("was")]
    ways = hops.withColumn("onward", F.lit(True))
    walks = cut(big.select(*keys, F.col("component").alias("id"), F.array("component").alias("walk"), F.lit(False).alias("closed"), F.lit(True).alias("fresh")))
    while not walks.filter("fresh AND NOT closed").isEmpty():
        for _ in range(HOPS):
            moved = walks.withColumn("onward", F.col("fresh") & ~F.col("closed")).join(ways, [*keys, "id", "onward"], "left")
            walks = moved.select(*keys, step).groupBy(*keys, F.col("n.id").alias("id"), F.col("n.closed").alias("closed")).agg(*told).select(
                *keys, "id", F.col("best.walk").alias("walk"), "closed", (F.col("was").isNull() | (F.col("best") < F.col("was"))).alias("fresh"))
        walks = cut(walks)
    return walks.filter("closed").select("project", F.col("walk").alias("cycle"))


def _chained(inner: DataFrame) -> DataFrame:
    """Links ``(project, component, id, next)`` with chains joined to one link; ``way`` lists the nodes after ``id`` up to ``next``.

    A node with one link in and one out, other than the component's own, joins the
    two; of neighbours a hashed coin decides, so a chain shrinks by a share each
    round.  A node stands in the way of one link only, so the table does not grow.
    """
    keys = ["project", "component"]
    single = F.col("n") == 1
    outs = inner.groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n")).filter(single).drop("n")
    ins = inner.groupBy(*keys, F.col("next").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter(single).drop("n")
    inside = stored(outs.join(ins, [*keys, "id"]).filter("id <> component"))
    links = inner.join(inside.withColumn("from_inside", F.lit(True)), [*keys, "id"], "left").join(
        inside.select(*keys, F.col("id").alias("next"), F.lit(True).alias("to_inside")), [*keys, "next"], "left").na.fill(False, ["from_inside", "to_inside"])
    links = stored(links.select(*keys, "id", "next", "from_inside", "to_inside", F.array("next").alias("way")))
    done, turn = [], 0
    while True:
        # Links between nodes that stay have nothing left to join.
        done.append(links.filter("NOT from_inside AND NOT to_inside").select(*keys, "id", "next", "way"))
        links = links.filter("from_inside OR to_inside")
        if links.isEmpty():
            break
        for _ in range(2):
            coin = lambda c, turn=turn: F.xxhash64(c, F.lit(turn)).bitwiseAND(F.lit(1).cast("bigint")) == 1
            joins = F.col("to_inside") & coin("next") & ~(F.col("from_inside") & coin("id"))
            heads, rest = links.filter(joins), links.filter(~joins)
            ends = links.select(*keys, F.col("id").alias("next"), F.col("next").alias("far"), F.col("to_inside").alias("far_inside"), F.col("way").alias("more"))
            joined = heads.join(ends, [*keys, "next"]).select(
                *keys, "id", F.col("far").alias("next"), "from_inside", F.col("far_inside").alias("to_inside"), F.concat("way", "more").alias("way"))
            links = joined.unionByName(rest.join(heads.select(*keys, F.col("next").alias("id")), [*keys, "id"], "left_anti"))
            turn += 1
        links = stored(links)
    return _merge(done)


def circular_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Edges with a flag for those that lie on some cycle.

    That is so exactly for loops and for edges within one of the strong
    ``components (project, id, component)``; no cycle is listed for it.
    """
    ends = [components.select("project", F.col("id").alias(end), F.col("component").alias(f"_{end}")) for end in ("src", "dst")]
    joined = edges.join(ends[0], ["project", "src"], "left").join(ends[1], ["project", "dst"], "left")
    flag = (F.col("src") == F.col("dst")) | F.coalesce(F.col("_src") == F.col("_dst"), F.lit(False))
    return joined.select(*edges.columns, flag.alias("circular"))
