"""Queries of the training-data operators against their SQL on a small table."""

import glob
import os

import duckdb
import pytest

from trivet.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, db, name):
    want = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda xs: sorted(tuple("null" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in x) for x in xs)
    pick = [want.columns.index(c) for c in cols]
    assert rows([[r[c] for c in cols] for r in got.collect()]) == rows([[r[i] for i in pick] for r in want.fetchall()])


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op5_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out and truth[r.doc_id]]
    assert len(rows) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.97
