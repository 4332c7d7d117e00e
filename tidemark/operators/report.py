"""Tidy extracts for reports: unions, unpivots, pivots and joins by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """All frames below each other with their name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(tag, F.lit(k)) for k, f in frames.items()])


def sampled(frame: DataFrame, most: int, key: str, seed: str = "sample") -> DataFrame:
    return frame.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(most)


def frontier_points(random: DataFrame, curve: DataFrame, most: int = 1000) -> DataFrame:
    """kind (random or curve), expected_return and volatility of at most most random portfolios and of all the curve's
    points; portfolio and sharpe are null along the curve, point among random ones."""
    points = curve.groupBy("point").agg(F.first("expected_return").alias("expected_return"), F.first("volatility").alias("volatility"))
    return union_tagged({"random": sampled(random, most, "portfolio"), "curve": points}, "kind")


def performance_rows(metrics: DataFrame) -> DataFrame:
    """A comparison's metrics under the names of the performance extract."""
    names = {"annual_return": "annualized_return", "annual_vol": "volatility", "sharpe": "sharpe_ratio"}
    kept = "strategy", "total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown", "final_value"
    return metrics.select(*(F.col(c).alias(names.get(c, c)) for c in kept))


def portfolio_weights(weights: DataFrame) -> DataFrame:
    """weights with an equal_weight portfolio over all their assets."""
    names = weights.select("asset").distinct()
    equal = names.crossJoin(names.agg((F.lit(1.0) / F.count("*")).alias("weight"))).select(F.lit("equal_weight").alias("portfolio"), "asset", "weight")  # one row
    return weights.select("portfolio", "asset", "weight").unionByName(equal)


def melted(metrics: DataFrame, names: list[str], key: str = "asset") -> DataFrame:
    """key, metric, value for the named columns, the key kept."""
    return metrics.unpivot([key], names, "metric", "value")


def percentiles(stats: DataFrame, key: str = "method") -> DataFrame:
    """key, percentile, value from the percentile columns of each row."""
    names = [c for c in stats.columns if c.startswith("percentile_")]
    long_ = stats.unpivot([key], names, "percentile", "value")
    return long_.withColumn("percentile", F.regexp_extract("percentile", "([0-9]+)$", 1).cast("int"))


def wide(panel: DataFrame, names: list[str] | None = None, key: str = "asset", value: str = "price") -> DataFrame:
    """A column for each series, for export."""
    return panel.groupBy("date").pivot(key, names).agg(F.first(value))


def long(frame: DataFrame, key: str = "asset", value: str = "price", date: str = "date") -> DataFrame:
    return frame.unpivot([date], [c for c in frame.columns if c != date], key, value).filter(F.col(value).isNotNull())


def drawdown_summary(dd: DataFrame, key: str = "strategy") -> DataFrame:
    """key, max_drawdown and its first date."""
    return dd.groupBy(key).agg(F.min("drawdown").alias("max_drawdown"), F.min_by("date", F.struct("drawdown", "date")).alias("date"))


def key_metrics(volatility: DataFrame, drawdowns: DataFrame, performance: DataFrame) -> DataFrame:
    """asset, annual_vol, max_drawdown, sharpe: joined by asset."""
    return volatility.select("asset", "annual_vol").join(drawdowns.select("asset", "max_drawdown"), "asset", "left").join(performance.select("asset", "sharpe"), "asset", "left")


def upper_triangle(pairs: DataFrame) -> DataFrame:
    return pairs.filter("asset_i > asset_j")


def top_holdings(weights: DataFrame, n: int = 5) -> DataFrame:
    """The n greatest weights of each portfolio, with their place."""
    place = F.row_number().over(W.partitionBy("portfolio").orderBy(F.desc("weight"), "asset"))
    return weights.withColumn("place", place).filter(F.col("place") <= n)


def bucketed(weights: DataFrame, least: float = 0.01) -> DataFrame:
    """Weights with those of at most least summed as Other."""
    name = F.when(F.col("weight") > least, F.col("asset")).otherwise("Other")
    return weights.groupBy("portfolio", name.alias("asset")).agg(F.sum("weight").alias("weight"))


def stat_by_method(stats: DataFrame, names: list[str], methods: list[str], key: str = "method") -> DataFrame:
    """statistic, and a column for each method."""
    return stats.unpivot([key], names, "statistic", "value").groupBy("statistic").pivot(key, methods).agg(F.first("value"))


def recommended(sharpes: DataFrame, cautious: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """profile, strategy: cautious for conservative; for balanced and aggressive the one of each pair with the greater
    sharpe, the first on ties. sharpes: strategy, sharpe."""
    spark = sharpes.sparkSession
    rows = [("conservative", cautious, 0)] + [(p, s, i) for p, pair in zip(("balanced", "aggressive"), pairs, strict=True) for i, s in enumerate(pair)]
    wanted = spark.createDataFrame(rows, "profile string, strategy string, turn int").join(sharpes, "strategy")
    return wanted.groupBy("profile").agg(F.max_by("strategy", F.struct("sharpe", -F.col("turn"))).alias("strategy"))
