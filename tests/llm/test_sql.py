"""Those queries that SQL can express, against it."""

import duckdb
import pytest

from quakeframe.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = c.execute(sql.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(n) for n in sorted(got.columns)]
    assert sorted(map(str, map(tuple, got.select(sorted(got.columns)).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
