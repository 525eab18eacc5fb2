import random

from pyspark.sql import functions as F

from corpuslode.operators import ranking as rk


def _rows(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.randrange(50), i, rng.randrange(1, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, v int, id int, tokens int")


def _ranks(rows):
    out = {}
    for k, v, i, _ in sorted(rows):
        out[i] = sum(1 for r in out.values() if r[0] == k) + 1, k
        out[i] = (k, out[i][0])
    return {i: r for i, (_, r) in out.items()}


def test_ordered_rank_equals_row_number(spark):
    rows, df = _rows(spark)
    got = {r.id: r.n for r in rk.ordered_rank(df, ["k"], ["v", "id"], "n").collect()}
    assert got == _ranks(rows)


def test_pages_partition_the_result(spark):
    rows, df = _rows(spark, 90)
    pages = [rk.paged(df, ["k"], ["v", "id"], page=p, size=7, clamp=False).collect() for p in range(1, 15)]
    ids = [r.id for page in pages for r in page]
    assert sorted(ids) == list(range(90))


def test_deep_pages_use_the_same_ranks(spark, monkeypatch):
    _, df = _rows(spark, 90)
    near = {r.id for r in rk.paged(df, ["k"], ["v", "id"], page=2, size=7).collect()}
    monkeypatch.setattr(rk, "TOP_K_DEPTH", 0)
    assert {r.id for r in rk.paged(df, ["k"], ["v", "id"], page=2, size=7).collect()} == near


def test_page_past_the_end(spark):
    _, df = _rows(spark, 30)
    assert rk.paged(df, ["k"], ["v", "id"], page=99, size=10, clamp=False).count() == 0
    last = rk.paged(df, ["k"], ["v", "id"], page=99, size=10).collect()
    assert last and all(r.current_page == r.total_pages and not r.has_next for r in last)


def test_fitting_prefix(spark):
    rows, df = _rows(spark, 120)
    got = {r.id for r in rk.fitting_prefix(df, ["k"], ["v", "id"], "tokens", limit=40).collect()}
    want, used = set(), {}
    stopped = set()
    for k, v, i, t in sorted(rows):
        used[k] = used.get(k, 0) + t
        if used[k] > 40:
            stopped.add(k)
        if k not in stopped:
            want.add(i)
    assert got == want


def test_proportional_cap(spark):
    rows = [("p", "big", i) for i in range(300)] + [("p", "small", i) for i in range(3)] + [("q", "big", i) for i in range(150)]
    df = spark.createDataFrame(rows, "project string, type string, id int")
    got = {(r.project, r.type): r.n for r in rk.proportional_cap(df, "type", ["id"]).groupBy("project", "type").agg(F.count("*").alias("n")).collect()}
    assert got == {("p", "big"): 198, ("p", "small"): 3, ("q", "big"): 150}


def test_ranks_of_vocabulary(spark):
    got = [r.r for r in spark.createDataFrame([(s,) for s in ("critical", "info", "odd")], "s string").select(rk.rank_of(F.col("s"), rk.SEVERITY_ORDER).alias("r")).collect()]
    assert got == [0, 4, 5]


def test_salted_top_k_equals_plain(spark, monkeypatch):
    _, df = _rows(spark, 200)
    take = lambda: {(r.k, r.id, r["rank"]) for r in rk.top_k(df, ["k"], [F.desc("v"), F.col("id")], 9).collect()}
    plain = take()
    monkeypatch.setattr(rk, "MAP_SIDE_LIMIT", 1)
    assert take() == plain
