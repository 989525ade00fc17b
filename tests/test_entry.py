"""Every query with SQL is checked against DuckDB on the smallest tables; the entry imports without the corpus operators."""

import os

import pytest

from netquarry.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["edges_event", "edges_tripartite", "giant_component", "local_clustering", "pagerank_20", "eccentricity", "modularity", "mod_trace", "rw_trace", "neighbors_partial", "replay_coverage", "sir_rounds", "er_edges", "id_dictionary"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_registry_is_whole():
    import __spark_entry__ as entry

    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir(DATA):
        assert entry.entry(spark).count() >= 5
