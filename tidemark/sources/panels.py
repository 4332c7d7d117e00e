"""Price and macro panels aggregated from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset (return flag and line status), price (revenue for a unit shipped that day)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"), F.concat("l_returnflag", "l_linestatus").alias("asset"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    )


def weekly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (Monday), asset (part type), price."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("p_type").alias("asset"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    )


def hourly_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts (hour), asset (event type), price (mean value)."""
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("ts"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("price"))


def monthly_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date (first of month), factor (order priority), value (mean order total)."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("date"), F.col("o_orderpriority").alias("factor"))
        .agg(F.avg("o_totalprice").alias("value"))
    )
