"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from skein.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert plain(tuple(r) for r in df.select(*names).collect()) == plain(want.fetchall())
