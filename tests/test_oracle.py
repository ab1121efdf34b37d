"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from gridloom.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    assert name in ORACLES
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    got = duck.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert mine == sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_plan_has_no_shuffle_but_its_join(spark, sf):
    plan = QUERIES["act_softmax"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "embedding" in plan and "Python" not in plan


def test_filter_reaches_the_scan(spark, sf):
    plan = QUERIES["batch_fetch"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "embedding#" not in plan
