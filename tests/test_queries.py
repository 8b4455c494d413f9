"""Every query against its SQL in DuckDB, on the smallest tables that give it rows."""

import math
import os

import duckdb
import pytest

from quakeframe import queries, sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "supplier", "orders", "lineitem", "events", "embeddings")
#: Queries that SQL has no equivalent for; they are tested in other modules.
ALONE = {"relocate_multi", "relocate_single"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def key(row):
    return tuple("" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9f}" if isinstance(v, float) else str(v) for v in row)


def test_all_queries_have_sql():
    assert set(queries.queries()) - set(sql.oracle_sql()) == ALONE
    assert set(sql.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.execute(sql.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert sorted(key(r) for r in got.select(*[f"`{c}`" for c in names]).collect()) == sorted(key([r[i] for i in at]) for r in want.fetchall())
