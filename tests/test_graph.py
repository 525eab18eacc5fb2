import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslode.functions import components, distances
from corpuslode.operators import graph as gr


def _graph(spark, seed, n=18, m=34):
    rng = random.Random(seed)
    edges = [("p", f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}", "import") for _ in range(m)]
    ids = {e[1] for e in edges} | {e[2] for e in edges} | {"z-alone"}
    return ids, edges, spark.createDataFrame([("p", i) for i in ids], "project string, id string"), spark.createDataFrame(edges, "project string, src string, dst string, type string")


def _distances(edges, start):
    out, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for _, a, b, _t in edges:
            if a == u and b not in out:
                out[b] = out[u] + 1
                queue.append(b)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_cycles_and_depth_match_brute_force(spark, seed):
    ids, edges, nodes, links = _graph(spark, seed)
    reach = {i: set(_distances(edges, i)) for i in ids}
    want = {}
    for i in ids:
        group = sorted(j for j in ids if j in reach[i] and i in reach[j])
        if len(group) > 1:
            want[i] = group[0]
    assert {r.id: r.component for r in gr.strong_components(links).collect()} == want

    pairs = {(a, b) for _, a, b, _t in edges}
    found = gr.cycles(links).collect()
    for row in found:
        assert row.cycle[0] == row.cycle[-1] and len(set(row.cycle[:-1])) == row.length
        assert all(step in pairs for step in zip(row.cycle, row.cycle[1:]))
        assert row.severity == ("critical" if len(row.cycle) <= 3 else "warning")
    assert {r.cycle[0] for r in found if r.length == 1} == {a for a, b in pairs if a == b}
    assert {tuple(r.cycle[:2]) for r in found if r.length == 2} == {(a, b) for a, b in pairs if a < b and (b, a) in pairs}

    incoming = {b for _, _a, b, _t in edges}
    roots = [i for i in ids if i not in incoming]
    depth = sum(max(_distances(edges, r).values()) for r in roots) / len(roots)
    assert gr.average_depth(nodes, links).collect()[0].avg_depth == pytest.approx(depth)


def test_farthest_of_many_roots(spark):
    """More roots than one word holds, a chain longer than one plan, cycles, a root without edges, two projects."""
    pick = random.Random(4)
    edges = [("p", f"n{i}", f"n{i + 1}") for i in range(15)] + [("p", "n15", "n3")]
    edges += [("p", f"r{i:03d}", f"n{pick.randrange(16)}") for i in range(150)] + [("q", "a", "b"), ("q", "b", "a"), ("q", "z", "a")]
    pairs = spark.createDataFrame(edges, "project string, id string, next string")
    asked = [("p", f"r{i:03d}") for i in range(150)] + [("p", "alone"), ("q", "z"), ("q", "a")]
    got = {(r.project, r.root): r.far for r in gr.farthest(spark.createDataFrame(asked * 2, "project string, root string"), pairs).collect()}
    for project, root in asked:
        inside = [(p, a, b, "") for p, a, b in edges if p == project]
        assert got[project, root] == max(_distances(inside, root).values()), (project, root)
    assert len(got) == len(asked)
    none = gr.farthest(spark.createDataFrame([], "project string, root string"), pairs)
    assert none.count() == 0


@pytest.mark.parametrize("n, ring, settings, rounds", [(60, 50, {}, 8), (60, 50, {"TASK_WORK": 1}, 8), (14, 10, {"TASK_LINKS": 15}, None)])
def test_farthest_in_tasks_and_in_waves(spark, monkeypatch, n, ring, settings, rounds):
    """Long chains and rings, one and several parts a project, a project too large for a task; nulls reach nothing."""
    edges = [("p", i, i + 1) for i in range(n)] + [("p", n, n // 2), ("p", -1, 0), ("p", -2, 0), ("p", -2, n - 3), ("p", -3, n // 2), ("p", -3, None), ("p", None, -4)]
    edges += [("q", i, (i + 1) % ring) for i in range(ring)] + [("q", -1, 3), ("q", -2, 7), ("q", 7, 60), (None, -1, 3)]
    pairs = spark.createDataFrame(edges * 2, "project string, id long, next long")
    want = {("p", -1): n + 1, ("p", -2): n // 2 + 1, ("p", -3): n - n // 2 + 1, ("p", None): 0, ("p", 500): 0, ("q", -1): ring, ("q", -2): ring, ("r", 1): 0, (None, -1): 0}
    written = []
    for name in ("cut", "stored"):
        plain = getattr(gr, name)
        monkeypatch.setattr(gr, name, lambda df, plain=plain: written.append(1) or plain(df))
    for name, value in settings.items():
        monkeypatch.setattr(gr, name, value)
    found = gr.farthest(spark.createDataFrame(list(want), "project string, root long"), pairs).collect()
    assert sorted(((str(r.project), str(r.root)), r.far) for r in found) == sorted(((str(p), str(i)), far) for (p, i), far in want.items())
    assert rounds is None or len(written) < rounds  # waves wrote twice every four hops


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_farthest_nodes_equal_brute_force(monkeypatch, cells):
    monkeypatch.setattr(distances, "CELLS", cells)
    pick = random.Random(cells)
    for n in (1, 2, 5, 9, 14, 30):
        for m in (0, n // 2, n, n + 3, 2 * n):
            pairs = {(pick.randrange(n), pick.randrange(n)) for _ in range(m)}
            pairs |= {(i, i + 1) for i in range(n - 1) if pick.random() < 0.4}
            if m == n:  # at most one link a node
                pairs = set(dict(pairs).items())
            src, dst = (np.array([p[k] for p in sorted(pairs)], np.int64) for k in (0, 1))
            far = distances.farthest_nodes(src, dst, n, np.arange(n))
            assert far.tolist() == [max(_distances([("p", a, b, "") for a, b in pairs], i).values()) for i in range(n)]


def test_degrees_coupling_hotspots(spark):
    edges = [("p", "god", f"o{i}", "import") for i in range(10)] + [("p", f"i{i}", "god", "import") for i in range(5)] + [("p", "i0", "god", "import")]
    ids = {e[1] for e in edges} | {e[2] for e in edges} | {"alone"}
    nodes = spark.createDataFrame([("p", i) for i in ids], "project string, id string")
    measured = gr.degrees(nodes, spark.createDataFrame(edges, "project string, src string, dst string, type string"))
    god = measured.filter("id = 'god'").collect()[0]
    assert (god.in_degree, god.out_degree, god.centrality) == (6, 10, 16 / len(ids))
    assert sorted(r.kind for r in gr.hotspots(measured).collect()) == ["bottleneck", "god-object", "hub"]
    metrics = gr.coupling_metrics(measured).collect()[0]
    assert (metrics.total_modules, metrics.max_dependencies, metrics.isolated) == (len(ids), 10, 1)
    assert metrics.coupling == pytest.approx(32 / len(ids))


def test_neighbourhood_depth_and_unknown_focus(spark):
    nodes = spark.createDataFrame([("p", x) for x in "abcd"] + [("q", "x")], "project string, id string")
    edges = spark.createDataFrame([("p", "a", "b", "t"), ("p", "c", "b", "t"), ("p", "c", "d", "t")], "project string, src string, dst string, type string")
    got = {(r.project, r.id): r.depth for r in gr.neighbourhood(nodes, edges, gr.focus_nodes(nodes, "a"), max_depth=2).collect()}
    assert got == {("p", "a"): 0, ("p", "b"): 1, ("p", "c"): 2, ("q", "x"): None}


def test_import_resolution_prefers_extension_order(spark, files):
    src = files(("p", "src/a.ts", "import x from './b';\nimport y from '../lib/c';\nimport z from './d';\nimport r from 'react';"),
                ("p", "src/b.tsx", ""), ("p", "src/b.ts", ""), ("p", "lib/c/index.js", ""), ("q", "src/d.ts", ""))
    got = {r.source: (r.target, r.external) for r in gr.resolve_imports(src).collect()}
    assert got == {"./b": ("src/b.ts", False), "../lib/c": ("lib/c/index.js", False), "./d": (None, False), "react": (None, True)}
    assert {r.dst for r in gr.import_edges(src, include_external=True).collect()} == {"src/b.ts", "lib/c/index.js", "react"}


def test_important_subgraph_keeps_small_projects_whole(spark):
    edges = [("big", f"n{i:03d}", f"n{(i * 7) % 60:03d}", "t") for i in range(60)] + [("small", "a", "b", "t")]
    ids = {(e[0], x) for e in edges for x in e[1:3]}
    nodes = spark.createDataFrame(list(ids), "project string, id string")
    kept, inner = gr.important_subgraph(nodes, spark.createDataFrame(edges, "project string, src string, dst string, type string"))
    counts = {r.project: r["count"] for r in kept.groupBy("project").count().collect()}
    assert counts == {"big": 50, "small": 2}
    names = {r.id for r in kept.filter("project = 'big'").collect()}
    assert all(r.src in names and r.dst in names for r in inner.filter("project = 'big'").collect())


def test_circular_edges(spark):
    pairs = ["ab", "bc", "ca", "cd", "de", "ec", "db", "ef", "ff"]
    edges = spark.createDataFrame([("p", *pair, "t") for pair in pairs], "project string, src string, dst string, type string")
    flags = {r.src + r.dst: r.circular for r in gr.circular_edges(edges, gr.strong_components(edges)).collect()}
    assert flags == {pair: pair != "ef" for pair in pairs}
    edges = spark.createDataFrame([("p", *pair, "t") for pair in ["ab", "bc", "ca", "cd"]], "project string, src string, dst string, type string")
    assert gr.cycles(edges).select(F.col("cycle")).collect()[0].cycle == ["a", "b", "c", "a"]


def _all_cycles(pairs, longest):
    out = {(a, a) for a, b in pairs if a == b} if longest else set()
    paths = [(a, b) for a, b in pairs if a < b]
    for _ in range(2, longest + 1):
        out |= {(*p, p[0]) for p in paths if (p[-1], p[0]) in pairs}
        paths = [(*p, b) for p in paths for a, b in pairs if a == p[-1] and b > p[0] and b not in p]
    return out


@pytest.mark.parametrize("seed, longest", [(1, 6), (2, 5), (3, 3), (4, 1), (5, 2)])
def test_simple_cycles_equal_brute_force(spark, seed, longest):
    _, edges, _, links = _graph(spark, seed, n=10, m=26)
    found = gr.simple_cycles(links, longest).collect()
    assert sorted(tuple(r.cycle) for r in found) == sorted(_all_cycles({(a, b) for _, a, b, _t in edges}, longest))
    parts = {r.id: r.component for r in gr.strong_components(links).collect()}
    for r in found:
        whole = parts.get(r.cycle[0], r.cycle[0])
        assert (r.component, r.members, r.length) == (whole, max(1, sum(c == whole for c in parts.values())), len(r.cycle) - 1)
    assert gr.simple_cycles(links.limit(0), longest).count() == 0


def test_hotspot_flag_is_that_of_the_kinds(spark):
    edges = [("p", "god", f"o{i}", "import") for i in range(10)] + [("p", f"i{i}", "god", "import") for i in range(5)] + [("p", f"i{i}", "hub", "import") for i in range(5)]
    ids = {e[1] for e in edges} | {e[2] for e in edges} | {"alone"}
    measured = gr.degrees(spark.createDataFrame([("p", i) for i in ids], "project string, id string"),
                          spark.createDataFrame(edges, "project string, src string, dst string, type string"))
    flagged = {r.id for r in gr.flag_hotspots(measured).collect() if r.hotspot}
    assert flagged == {r.id for r in gr.hotspots(measured).collect()} == {"god", "hub"} and gr.flag_hotspots(measured).count() == len(ids)


def test_rounds_for_components_do_not_grow_with_the_length_of_a_cycle(spark, monkeypatch):
    n, rounds = 400, []
    ring = [("p", i, (i + 1) % n) for i in range(n)] + [("p", 5, n), ("p", n, n + 1), ("p", n + 2, 7)]
    detour = [("p", 10, 900), ("p", 900, 901), ("p", 901, 12)]
    for name in ("cut", "stored"):
        plain = getattr(gr, name, gr.cut)
        monkeypatch.setattr(gr, name, lambda df, plain=plain: rounds.append(1) or plain(df), raising=False)
    links = spark.createDataFrame(ring + detour, "project string, src long, dst long")
    got = {r.id: r.component for r in gr.strong_components(links).collect()}
    assert got == dict.fromkeys([*range(n), 900, 901], 0)
    assert len(rounds) < 90  # a hop a node took over a hundred


def test_rounds_for_witness_cycles_do_not_grow_with_their_length(spark, monkeypatch):
    n, rounds = 300, []
    ring = [("p", i, (i + 1) % n) for i in range(n)]
    # Two detours of equal length, a shorter one, a ring that is left and entered again, and a ring without any branch.
    more = [("p", 10, 901), ("p", 901, 12), ("p", 40, 903), ("p", 903, 904), ("p", 904, 60), ("p", 70, 905), ("p", 905, 70)]
    lone = [("q", i, (i + 1) % 50) for i in range(50)]
    for name in ("cut", "stored"):
        plain = getattr(gr, name)
        monkeypatch.setattr(gr, name, lambda df, plain=plain: rounds.append(1) or plain(df))
    monkeypatch.setattr(gr, "strong_components", lambda links: links.select("project", F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("component", F.lit(0)))
    found = {r.project: r.cycle for r in gr.witness_cycles(spark.createDataFrame(ring + more + lone, "project string, src long, dst long")).collect()}
    assert found == {"p": [*range(41), 903, 904, *range(60, n), 0], "q": [*range(50), 0]}
    assert len(rounds) < 40  # a hop a node took over a hundred


@pytest.mark.parametrize("few", [0, 64])
def test_components_and_least_cycles_of_a_task_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    for seed in range(150):
        pick = random.Random(seed)
        n = pick.randrange(1, 12)
        pairs = sorted({(pick.randrange(n), pick.randrange(n)) for _ in range(pick.randrange(2 * n + 1))} - {(i, i) for i in range(n)})
        src, dst = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        reach = [set(_distances([("p", a, b, "") for a, b in pairs], i)) for i in range(n)]
        found = components.component_of(src, dst, n)
        assert found.tolist() == [min(j for j in reach[i] if i in reach[j]) for i in range(n)]
        inside = found[src] == found[dst]
        homes = np.flatnonzero(np.bincount(found, minlength=n) > 1)
        cycles = components.least_cycles(src[inside], dst[inside], n, homes)
        for home, cycle in zip(homes.tolist(), cycles, strict=True):
            through = [(*p, home) for p in _paths({p for p in pairs}, home, n) if (p[-1], home) in pairs]
            assert tuple(cycle) == min(through, key=lambda c: (len(c), c))


def _paths(pairs, home, n):
    out = paths = [(home,)]
    for _ in range(n - 1):
        paths = [(*p, b) for p in paths for a, b in pairs if a == p[-1] and b not in p]
        out = out + paths
    return out[1:]


@pytest.mark.parametrize("links", [0, 1 << 21])
def test_components_and_witnesses_by_size_of_a_project(spark, monkeypatch, links):
    """In a task, or labelled and walked as a whole; a null project and null ends are on no cycle."""
    monkeypatch.setattr(gr, "TASK_LINKS", links)
    ring = [("p", f"n{i:02d}", f"n{(i + 1) % 20:02d}") for i in range(20)] + [("p", "n03", "n12"), ("p", "n15", "n02"), ("p", "x", "n01"), ("p", "n07", "y")]
    more = [("q", "a", "b"), ("q", "b", "c"), ("q", "c", "a"), ("q", "c", "d"), ("q", "d", "b"), ("q", "e", "f"), ("q", "f", "e"), ("q", "g", "g")]
    odd = [(None, "a", "b"), (None, "b", "a"), ("q", None, "a"), ("q", "a", None)]
    edges = spark.createDataFrame((ring + more + odd) * 2, "project string, src string, dst string")
    got = {(r.project, r.id): r.component for r in gr.strong_components(edges).collect()}
    want = {("p", f"n{i:02d}"): "n00" for i in range(20)} | {("q", i): "a" for i in "abcd"} | {("q", "e"): "e", ("q", "f"): "e"}
    assert got == want
    found = sorted((r.project, r.cycle) for r in gr.witness_cycles(edges.distinct()).collect())
    assert found == [("p", ["n00", "n01", "n02", "n03", *[f"n{i}" for i in range(12, 20)], "n00"]), ("q", ["a", "b", "c", "a"])]


def test_components_of_a_long_ring_take_few_writes(spark, monkeypatch):
    written = []
    for name in ("cut", "stored"):
        plain = getattr(gr, name)
        monkeypatch.setattr(gr, name, lambda df, plain=plain: written.append(1) or plain(df))
    n = 3000
    edges = spark.range(n).selectExpr("'p' AS project", "id AS src", f"(id + 1) % {n} AS dst").unionByName(
        spark.range(n // 3).selectExpr("'p' AS project", "id * 3 AS src", f"(id * 3 + 2) % {n} AS dst"))
    assert gr.strong_components(edges).groupBy("component").count().collect()[0].asDict() == {"component": 0, "count": n}
    assert len(written) < 8  # labels by hops and contraction wrote dozens of tables
    assert [r.length for r in gr.cycles(edges).collect()] == [n * 2 // 3]
    assert len(written) < 24


def test_circular_edges_of_a_long_ring_take_few_writes(spark, monkeypatch):
    written = []
    for name in ("cut", "stored"):
        plain = getattr(gr, name)
        monkeypatch.setattr(gr, name, lambda df, plain=plain: written.append(1) or plain(df))
    n = 1000
    edges = spark.range(n).selectExpr("'p' AS project", "id AS src", f"(id + 1) % {n} AS dst").unionByName(
        spark.range(n // 2).selectExpr("'p' AS project", f"id + {n} AS src", "id AS dst"))
    flags = gr.circular_edges(edges, gr.strong_components(edges)).groupBy("circular").count().collect()
    assert {r.circular: r["count"] for r in flags} == {True: n, False: n // 2}
    assert len(written) < 8  # rounds of contraction and labels wrote dozens of tables
