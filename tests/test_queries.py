"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from loomstone.plans.queries import ORACLE_SQL, QUERIES

from conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SMALL}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and pd.isna(value)) or value is pd.NA:
        return None
    if hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return tuple(value.tolist())
    if isinstance(value, float):
        return round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
