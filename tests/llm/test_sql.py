"""Queries that SQL can express agree with it on whole tables."""

from __future__ import annotations

import duckdb
import pytest

from fieldspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(tuple, cur.fetchall()))
    assert sorted(tuple(r[c] for c in cols) for r in queries.queries()[name](spark, SF).collect()) == want
