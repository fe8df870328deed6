"""Every registered query against its SQL answer on the smallest tables."""

import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from planewatch.plans import oracle, registry

QUERIES, SQL = registry.all_queries(), oracle.all_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    return con


def as_text(rows):
    return Counter(tuple(str(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)
    got = as_text(df.select(columns).collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == as_text(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["hour", "key_alias", "blocked_requests"]
