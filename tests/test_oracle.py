"""Every registered query against its SQL equivalent on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from workload.catalog import QUERIES
from workload.oracle import ORACLE

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ["lineitem", "orders", "events", "pages"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


# The same types by their names in both systems.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def canonical(rows):
    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else f"{value:.9g}"
        return repr(value)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLE[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    types = {c[0]: str(c[1]) for c in theirs.description}
    assert {n: TYPES[t] for n, t in ours.dtypes} == types
    expected = theirs.fetchall()
    got = [tuple(row) for row in ours.select(*columns).collect()]
    assert canonical(got) == canonical(expected)
    assert expected, "the query should not be empty at this scale"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_stays_declarative(spark, name):
    """No Python in the plan, no cross joins, and no table read with all its columns."""
    query = QUERIES[name](spark, SF)
    plan = query._jdf.queryExecution().executedPlan().toString()
    for banned in ("Python", "CartesianProduct", "NestedLoopJoin"):
        assert banned not in plan
    for unused in ("l_extendedprice:", "o_orderpriority:", "html:", "props:"):
        assert unused not in plan  # of the columns in a ReadSchema


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == [
        "domain", "method", "ipport", "request", "agent", "referer", "count",
    ]
    assert rows.count() > 0
