"""Every query with SQL against that SQL, on the smallest tables whose panels hold."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(x + 0.0)
        return x.isoformat()[:10] if hasattr(x, "isoformat") else repr(x)

    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    frame, relation = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(relation.columns)
    got = canonical([tuple(r) for r in frame.collect()], frame.columns)
    assert got == canonical(relation.fetchall(), list(relation.columns))
    spark.catalog.clearCache()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
