"""Every registered query of the grid operators runs; those with SQL agree with it."""

from __future__ import annotations

import duckdb
import pytest

from fieldspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, other, name):
    df = catalog.queries()[name](spark, SF)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    cur = other.execute(catalog.oracle_sql()[name])
    names, want = [c[0] for c in cur.description], cur.fetchall()
    assert sorted(cols) == sorted(names)
    order = sorted(cols)
    pick = lambda table, own: sorted(tuple(norm(r[own.index(c)]) for c in order) for r in table)
    assert pick(rows, cols) == pick(want, names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.columns and df.count() > 0
