"""Seeded Monte Carlo paths and stress tests.

Draws are hashes of (seed, path, day): the same in any partitioning, on any engine. Paths never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import stats

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
TARGETS = (-0.2, 0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0)


def _days(spark: SparkSession, paths: int, horizon: int) -> DataFrame:
    return spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day"))


def _values(draws: DataFrame, initial: float) -> DataFrame:
    upto = W.partitionBy("path").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return draws.select("path", "day", (initial * F.product(1 + F.col("ret")).over(upto)).alias("value"))


def parametric(history: DataFrame, paths: int = 1000, horizon: int = 1260, initial: float = config.INITIAL_INVESTMENT, seed: str = "mc") -> DataFrame:
    """path, day, value. history: date, ret of the portfolio. With fixed weights a day's portfolio return of jointly
    normal assets is one normal, of the history's mean and deviation."""
    own = history.agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sigma"))
    days = _days(history.sparkSession, paths, horizon).crossJoin(F.broadcast(own))  # one row
    return _values(days.select("path", "day", (F.col("mu") + F.col("sigma") * stats.normal(seed, F.col("path"), F.col("day"))).alias("ret")), initial)


def _numbered(history: DataFrame) -> DataFrame:
    """place (from 0), ret: a row a date."""
    return history.select((F.row_number().over(W.orderBy("date")) - 1).cast("long").alias("place"), "ret")


def historical(history: DataFrame, paths: int = 1000, horizon: int = 1260, initial: float = config.INITIAL_INVESTMENT, seed: str = "mc") -> DataFrame:
    """path, day, value: days drawn from history with replacement."""
    total = history.agg(F.count("*").alias("n"))
    days = _days(history.sparkSession, paths, horizon).crossJoin(F.broadcast(total))  # one row
    place = F.floor(stats.uniform(seed, F.col("path"), F.col("day")) * F.col("n")).cast("long")
    return _values(days.withColumn("place", place).join(_numbered(history), "place"), initial)


def block_bootstrap(history: DataFrame, paths: int = 1000, horizon: int = 1260, block: int = 20, initial: float = config.INITIAL_INVESTMENT, seed: str = "mc") -> DataFrame:
    """path, day, value: blocks of consecutive days; starts are in [0, n - block), so the last block is never drawn."""
    total = history.agg(F.count("*").alias("n"))
    days = _days(history.sparkSession, paths, horizon).withColumn("block", F.floor((F.col("day") - 1) / block).cast("long")).crossJoin(F.broadcast(total))  # one row
    start = F.floor(stats.uniform(seed, F.col("path"), F.col("block")) * (F.col("n") - block)).cast("long")
    return _values(days.withColumn("place", start + (F.col("day") - 1) % block).join(_numbered(history), "place"), initial)


def final_stats(paths: DataFrame, initial: float = config.INITIAL_INVESTMENT, year: int = config.TRADING_DAYS) -> DataFrame:
    """One row: mean, median, least, greatest and deviation (of the whole) of final values, the mean's yearly return,
    percentiles, and the shares that reach each target return."""
    last = paths.groupBy("path").agg(F.max_by("value", "day").alias("value"), F.max("day").alias("horizon"))
    v = F.col("value")
    share = lambda t: F.avg((v >= initial * (1 + t)).cast("double"))
    return last.agg(
        F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"),
        (F.pow(F.avg(v) / initial, year / F.max("horizon")) - 1).alias("annualized_return"),
        *(F.percentile(v, F.lit(p / 100)).alias(f"percentile_{p}") for p in PERCENTILES),
        *(share(t).alias(f"prob_{'minus_' if t < 0 else ''}{abs(round(t * 100))}") for t in TARGETS),
    )


def target_table(summary: DataFrame) -> DataFrame:
    """target (a return), probability: the shares of final_stats by number."""
    pairs = [F.struct(F.lit(float(t)).alias("target"), F.col(f"prob_{'minus_' if t < 0 else ''}{abs(round(t * 100))}").alias("probability")) for t in TARGETS]
    return summary.select(F.inline(F.array(*pairs)))


def sampled_paths(paths: DataFrame, most: int = 100, seed: str = "sample") -> DataFrame:
    """At most so many whole paths, those with the least hash."""
    ids = paths.select("path").distinct().orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("path").cast("string")).cast("binary")), "path").limit(most)
    return paths.join(F.broadcast(ids), "path")  # at most `most` rows


def bands(paths: DataFrame, percentiles: tuple[int, ...] = (5, 50, 95)) -> DataFrame:
    return paths.groupBy("day").agg(*(F.percentile("value", F.lit(p / 100)).alias(f"p{p}") for p in percentiles))


#: The default scenarios of daily returns; those of dates are from, to.
SCENARIOS = {"bearish": [-0.02] * 10 + [-0.05] * 5 + [-0.03] * 10, "volatile": [0.015] * 20 + [-0.03] * 10 + [0.01] * 15}
DEFAULT_PATH = [-0.01, -0.02, -0.03, -0.02, -0.01]


def scenario_frame(spark: SparkSession, scenarios: dict[str, list[float]]) -> DataFrame:
    """scenario, step (from 1), ret; an empty list takes the default path."""
    rows = [(k, v or DEFAULT_PATH) for k, v in scenarios.items()]
    return spark.createDataFrame(rows, "scenario string, rets array<double>").select("scenario", F.posexplode("rets").alias("step", "ret")).withColumn("step", F.col("step") + 1)


def window_scenarios(history: DataFrame, windows: DataFrame) -> DataFrame:
    """scenario, step, ret of history between start and end of windows (scenario, start, end), where both dates are in
    history; other scenarios have no rows."""
    dates = history.select("date").distinct()
    ok = windows.join(dates.withColumnRenamed("date", "start"), "start", "left_semi").join(dates.withColumnRenamed("date", "end"), "end", "left_semi")
    # windows are few and short of history: their dates are listed and joined by equality
    days = ok.select("scenario", F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("date"))
    step = F.row_number().over(W.partitionBy("scenario").orderBy("date"))
    return days.join(history, "date").select("scenario", step.alias("step"), "ret")


def stress(steps: DataFrame, initial: float = config.INITIAL_INVESTMENT) -> DataFrame:
    """scenario, initial_value, final_value, total_return, max_drawdown (the start isn't a peak) and days."""
    upto = W.partitionBy("scenario").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    valued = steps.withColumn("value", initial * F.product(1 + F.col("ret")).over(upto)).withColumn("dd", F.try_divide("value", F.max("value").over(upto)) - 1)
    return valued.groupBy("scenario").agg(
        F.lit(initial).alias("initial_value"), F.max_by("value", "step").alias("final_value"), (F.max_by("value", "step") / initial - 1).alias("total_return"),
        F.min("dd").alias("max_drawdown"), F.count("*").alias("days"),
    )
