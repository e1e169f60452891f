"""Every query that has SQL, against DuckDB on the driver's tables."""

import os

import duckdb
import pytest

from factloom.plans import catalog, grown, roundtrips  # noqa: F401  (registers its queries)


def normal(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: "null" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(clean(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_utf8_tokens_of_every_document(spark, tmp_path):
    rows = [(1, "abc"), (2, "äb"), (3, ""), (4, None), (5, "\U0001f600"), (None, "é")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.QUERIES["utf8_tokens"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, 3, 97), (2, 3, 195), (3, 0, None), (4, None, None), (5, 4, 240), (None, 2, 195)], key=str)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(catalog.ORACLE["utf8_tokens"]).fetchall(), key=str) == got


def test_more_than_a_thousand_types(spark, tmp_path):
    spark.range(1001).selectExpr("concat('t', id) as event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert len(catalog.event_types(spark, str(tmp_path))) == 1001
    spark.range(1002).selectExpr("id as p_partkey", "0 as p_size", "if(id < 1001, concat('T', id), 'X SMALL') as p_type").write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.QUERIES["prop_filter"](spark, str(tmp_path)).count() == 1001


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["next_token", "numleaves"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_constrained_decode_emits_distinct_facts(spark, sf):
    rows = catalog.QUERIES["constrained_decode"](spark, sf).collect()
    done = [(r["state"], r["tokens"]) for r in rows if r["status"] == "COMPLETE"]
    assert len(done) == len(set(done)) == 50
    assert all(t.endswith(" .") for _, t in done)
