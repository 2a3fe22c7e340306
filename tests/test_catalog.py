"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame: pd.DataFrame) -> list[str]:
    def value(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 5) if isinstance(x, float) or hasattr(x, "__index__") else str(x)  # whole numbers beside nulls may come as floats

    return sorted(repr([value(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _names():
    from tessera.plans import catalog

    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, db, name):
    from tessera.plans import catalog

    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.SQL:
        want = db.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_settings_and_pools_come_from_the_events(spark):
    """As many settings and requests as the table has events; none is made up."""
    from tessera.plans import catalog
    from tessera.plans.search import pool_size

    d = "/root/testdata/sf0.001"
    n, items = (spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("events", "part"))
    pools = catalog.QUERIES["pool_sizes"](spark, d).collect()
    assert sum(r["requests"] for r in pools) == n and all(r["pool"] == pool_size(r["top_k"], items) for r in pools)
    read = {r["kind"]: r for r in catalog.QUERIES["config_sources"](spark, d).collect()}
    assert sum(r["given"] for r in read.values()) == n and set(read) == {"bm25", "semantic", "fusion", "personal"}
    assert all(r["accepted"] > 0 and r["refused"] > 0 and r["accepted"] + r["refused"] == r["given"] for r in read.values())
