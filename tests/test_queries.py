"""Registered queries against their SQL on the smallest tables.

The cheap ones always run; CORPUSLODE_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["document_secret_scores", "name_casing", "graph_coupling", "glob_selection", "event_counts_tumbling", "task_analysis", "test_profiles"]

pytestmark = pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{entry.SMOKE_DIR}/{name}.parquet'")
    return con


def _plain(v):
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("CORPUSLODE_ALL") else CHEAP)
def test_query_matches_sql(spark, oracle, name):
    df = entry.queries()[name](spark, entry.SMOKE_DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = oracle.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_every_query_has_sql():
    """All but the optional training-data queries, most of which SQL cannot express."""
    from corpuslode.queries import load

    assert set(load()) <= set(entry.oracle_sql())
