"""Queries by name, each with the SQL that restates it, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import OFFSET, tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as the SQL rounds them, so that both engines' sums agree."""
    return df.select(*(tidy(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query under its function's name; its doubles are rounded."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def r(expression: str, name: str, digits: int = 6) -> str:
    """The expression rounded as tidy() rounds it."""
    return f"round({expression} + {OFFSET * 10.0**-digits!r}::DOUBLE, {digits}) + 0.0 AS {name}"


#: The panels as common table expressions.
WEEKLY = """panel AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_type AS asset, sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
DAILY = """panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag || l_linestatus AS asset, sum(l_extendedprice) / sum(l_quantity) AS price
  FROM lineitem GROUP BY 1, 2)"""
MACRO = """macro AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_orderpriority AS factor, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"""
CELLS = """cells AS (
  SELECT d.date, a.asset, p.price FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN (SELECT DISTINCT asset FROM panel) a
  LEFT JOIN panel p ON p.date = d.date AND p.asset = a.asset)"""
FILLED = """filled AS (
  SELECT date, asset, coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM cells)"""


def returns_of(table: str, name: str = "r") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT date, asset, price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS ret FROM {table}) WHERE ret IS NOT NULL)"""


WEEKLY_RETURNS = f"{WEEKLY}, {returns_of('panel')}"
#: Population moments in the corrected forms that pandas gives come ready from the SQL engine.
