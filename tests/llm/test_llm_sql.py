"""Queries with SQL give the same rows in Spark and DuckDB, at the smallest scale."""

import os
from collections import Counter

import pytest

from lacegraph.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    names, expected = [d[0] for d in rel.description], rel.fetchall()
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(expected)
