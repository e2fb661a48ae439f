"""Registered corpus queries against their SQL in DuckDB, and token digests against the library."""

from __future__ import annotations

import hashlib
import os

import duckdb
import numpy as np
import pytest

from conftest import SMALL
from loomstone.llm.bpe import encoder
from loomstone.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        path = f"{SMALL}/{table}.parquet"
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda frame: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_token_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op6_bpe"](spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = encoder().core.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
