"""Every registered query runs, and equals its SQL."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from evenspan.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: x if isinstance(x, str) else repr(x.tolist() if isinstance(x, np.ndarray) else x))
        elif df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True).astype(str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        if "rank" in got:  # merges: each is the most frequent pair after those before it
            assert got["rank"].tolist() == list(range(len(got)))
            assert "n" not in got or (got["n"].diff().dropna() <= 0).all()
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got).equals(normal(want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
