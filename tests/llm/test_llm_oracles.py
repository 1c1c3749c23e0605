from __future__ import annotations

import duckdb
import pytest

from pagewright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert sorted(map(tuple, df.collect())) == sorted(want)
