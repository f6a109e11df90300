"""Registered queries with SQL, against DuckDB on the small tables; all others run and keep every document."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from shelfcast.llm import queries
from tools.check import close, table

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_all_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {view} as select * from '{FOLDER}/{view}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    got = table(df.columns, df.collect())
    res = con.execute(queries.ORACLES[name])
    want = table([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert all(close(a, b) for x, y in zip(got[1], want[1], strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES and n not in ("op7_token_counts", "op10_pack")])
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = queries.QUERIES[name](spark, FOLDER).select("doc_id")
    assert got.count() == docs.count() and got.distinct().count() == docs.count()
