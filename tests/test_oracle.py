"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from graphloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 9))
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return v.isoformat()[:19].replace("T00:00:00", "") if hasattr(v, "isoformat") else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, name):
    query = plans.QUERIES[name](spark, SF)
    assert query.columns and query.collect() is not None
