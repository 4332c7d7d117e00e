"""Seeded panels for tests and demonstrations: the same rows in any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import normal


def business_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("date")).filter(F.weekday("date") < 5)


def prices(spark: SparkSession, assets: dict[str, tuple[float, float, float]], start: str, end: str, seed: str = "prices", crash: tuple[str, str] = ("2020-02-20", "2020-03-23"), fall: float = -0.03) -> DataFrame:
    """date, asset, price. assets: name to (first price, daily mean, daily deviation). A day's return has a fifth of the
    day before's shock added, and between the crash's dates falls by fall."""
    table = spark.createDataFrame([(k, *map(float, v)) for k, v in assets.items()], "asset string, p0 double, mu double, sigma double")
    cells = business_days(spark, start, end).crossJoin(F.broadcast(table))  # a row an asset that the caller names
    w = W.partitionBy("asset").orderBy("date")
    shocked = cells.withColumn("shock", F.col("sigma") * normal(seed, F.col("asset"), F.date_format("date", "yyyy-MM-dd")))
    ret = F.col("mu") + F.col("shock") + 0.2 * F.coalesce(F.lag("shock").over(w), F.lit(0.0)) + F.when(F.col("date").between(*crash), fall).otherwise(0.0)
    return shocked.withColumn("ret", ret).select("date", "asset", (F.col("p0") * F.product(1 + F.col("ret")).over(w.rowsBetween(W.unboundedPreceding, 0))).alias("price"))


def macro(spark: SparkSession, factors: dict[str, tuple[float, float, float, bool]], start: str, end: str, seed: str = "macro") -> DataFrame:
    """date, factor, value on business days. factors: name to (first value, monthly mean, deviation, additive). Additive
    factors step up and down but never under zero, others grow by shares; values hold until the next month."""
    table = spark.createDataFrame([(k, float(a), float(b), float(c), bool(d)) for k, (a, b, c, d) in factors.items()], "factor string, v0 double, mu double, sigma double, additive boolean")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month"))
    steps = months.crossJoin(F.broadcast(table)).withColumn("step", F.col("mu") + F.col("sigma") * normal(seed, F.col("factor"), F.date_format("month", "yyyy-MM")))  # a row a factor
    w = W.partitionBy("factor").orderBy("month")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    total = F.col("v0") + F.sum("step").over(upto)
    walked = steps.withColumn("total", total)
    # max(0, previous + step) is the total lifted by how far it has ever been under zero
    floored = F.col("total") - F.least(F.min("total").over(upto), F.lit(0.0))
    grown = F.col("v0") * F.product(1 + F.col("step")).over(upto)
    monthly = walked.select("month", "factor", F.when(F.col("additive"), floored).otherwise(grown).alias("value"))
    days = business_days(spark, start, end).withColumn("month", F.trunc("date", "MM"))
    return days.join(monthly, "month").select("date", "factor", "value")
