"""Every registered query against its reference SQL, and its plan against what a cluster cannot run."""

import math

import duckdb
import pytest

from cellwright.catalog import registry
from cellwright.catalog.fixtures import TABLES
from tests.conftest import SF_DIR

QUERIES = registry()
# One row meets many without a condition, or Python works row by row.
BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"float {round(v, 6) + 0.0}"
    return f"{type(v).__name__} {v}"


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_norm(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_reference_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BANNED if b in plan]
    got = _table(df.columns, df.collect())
    cursor = duck.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = _table(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want
