"""Registered queries against SQL on the same tables, and the shape of the pipeline."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from headerwise.llm.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_registered():
    assert QUERIES.items() <= contract.queries().items()
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = con.execute(ORACLE[name])
    columns = [c[0] for c in theirs.description]
    ours = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(ours.columns)
    got = sorted(repr(tuple(r)) for r in ours.select(*columns).collect())
    assert got == sorted(map(repr, theirs.fetchall()))


def test_native_queries_run_no_python(spark):
    for name in ("op3_sharding", "op6_pii", "op9_lines"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian"))


def test_pipeline(spark):
    found = corpus_pipeline.run(spark, SF)
    rows = found.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert 0.7 * len(docs) < len(rows) < len(docs)
    assert all(r.round_trip and r.parity and r.doc_id in docs for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
