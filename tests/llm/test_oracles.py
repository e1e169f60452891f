"""The corpus queries that have SQL, against DuckDB on the driver's tables."""

import os

import duckdb
import pytest

from factloom.llm import queries


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in at) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, sf, name):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = queries.QUERIES[name](spark, sf), c.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names) and rows(got.columns, got.collect()) == rows(names, want.fetchall())
