import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([r[k] for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_sql(spark, tables, name):
    got = own.QUERIES[name](spark, SF)
    want = tables.sql(own.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming_batches_that_are_run_again(spark, tmp_path):
    from lodestone.streaming.ingest import appender

    make = lambda pairs: spark.createDataFrame(pairs, "doc_id long, text string")
    append = appender(f"{tmp_path}/t", "doc_id")
    append(make([(2, "a"), (1, "a"), (3, "b"), (4, None)]), 0)
    for _ in range(2):
        append(make([(5, "b"), (6, "c")]), 1)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 3, 6]


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert not own.QUERIES[name](spark, SF).isEmpty()
