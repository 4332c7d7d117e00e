"""Statistics of data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quantiles, stats
from .cleaning import complete_dates, series
from .gram import pair_stats
from .stationarity import adf  # noqa: F401


def profile(cells: DataFrame) -> DataFrame:
    """One row: series, first and last date, dates, null cells and their share in per cent."""
    null = F.col("price").isNull()
    return cells.agg(
        F.countDistinct("asset").alias("n_assets"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.countDistinct("date").alias("n_dates"),
        F.count_if(null).alias("n_null"),
        F.avg(null.cast("double") * 100).alias("null_pct"),
    )


def return_stats(returns: DataFrame) -> DataFrame:
    r = F.col("ret")
    return returns.groupBy("asset").agg(
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), F.min(r).alias("min"), F.max(r).alias("max"), stats.skew(r).alias("skew"), stats.excess_kurtosis(r).alias("kurtosis")
    )


def jarque_bera(returns: DataFrame, level: float = 0.05) -> DataFrame:
    """The statistic, its p-value (chi-squared with two degrees of freedom: exp(-jb/2)), and whether normality holds."""
    tested = returns.groupBy("asset").agg(stats.jarque_bera(F.col("ret")).alias("jb"))
    return tested.withColumn("p_value", F.exp(-F.col("jb") / 2)).withColumn("normal", F.col("p_value") > level)


def correlation_flags(pairs: DataFrame, same: float = 0.99, opposite: float = -0.9) -> DataFrame:
    """asset_i < asset_j with flag duplicate or extreme_negative; a pair may have both."""
    half = pairs.filter("asset_i < asset_j").select("asset_i", "asset_j", "correlation")
    duplicates = half.filter(F.abs("correlation") > same).withColumn("flag", F.lit("duplicate"))
    return duplicates.unionByName(half.filter(F.col("correlation") < opposite).withColumn("flag", F.lit("extreme_negative")))


def rolling_vol(returns: DataFrame, rows: int = 20, year: int = 252) -> DataFrame:
    """date, asset, vol: yearly deviation over full windows."""
    w = series().rowsBetween(1 - rows, 0)
    vol = F.when(F.count("ret").over(w) == rows, F.stddev_samp("ret").over(w) * F.sqrt(F.lit(float(year))))
    return returns.withColumn("vol", vol).filter("vol IS NOT NULL").select("date", "asset", "vol")


def rolling_vol_stats(returns: DataFrame) -> DataFrame:
    return rolling_vol(returns).groupBy("asset").agg(F.min("vol").alias("min_vol"), F.max("vol").alias("max_vol"), F.avg("vol").alias("avg_vol"))


def extreme_vol(returns: DataFrame, times: float = 3.0) -> DataFrame:
    """date, asset, vol where it is above times the series' mean."""
    mean = F.avg("vol").over(W.partitionBy("asset"))
    return rolling_vol(returns).withColumn("_mean", mean).filter(F.col("vol") > times * F.col("_mean")).drop("_mean")


def validation_summary(cells: DataFrame, returns: DataFrame) -> DataFrame:
    """One row: passed (no nulls), how many series fail normality, flagged pairs, and rows of extreme volatility."""
    nulls = cells.agg((F.count_if(F.col("price").isNull()) == 0).alias("passed"), F.countDistinct("asset").alias("n_assets"))
    normal = jarque_bera(returns).agg(F.count_if(~F.col("normal")).alias("n_not_normal"))
    flags = correlation_flags(pair_stats(returns)).agg(F.count("*").alias("n_correlation_flags"))
    rows = extreme_vol(returns).agg(F.count("*").alias("n_extreme_rows"))
    return nulls.crossJoin(normal).crossJoin(flags).crossJoin(rows)  # a row each


def macro_stats(macro: DataFrame) -> DataFrame:
    v = F.col("value")
    first, last = F.min_by("value", "date"), F.max_by("value", "date")
    return macro.filter(v.isNotNull()).groupBy("factor").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), first.alias("first"), last.alias("last"), (last - first).alias("change")
    )


def autocorrelation(panel: DataFrame, key: str = "factor", value: str = "value", lags: tuple[int, ...] = (1, 2, 3), least: int = 10) -> DataFrame:
    """key, lag, acf: biased (divided by the whole sample's squares), for series of more than least values."""
    w = series(key)
    own = W.partitionBy(key)
    x = panel.filter(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(own)).withColumn("_n", F.count("*").over(own)).filter(F.col("_n") > least)
    shifted = x.select(key, "_d", *(F.lag("_d", k).over(w).alias(f"_{k}") for k in lags))
    sums = shifted.groupBy(key).agg(F.sum(F.col("_d") * F.col("_d")).alias("_ss"), *(F.sum(F.col("_d") * F.col(f"_{k}")).alias(f"_{k}") for k in lags))
    return sums.select(key, "_ss", F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("_s")) for k in lags)))).select(key, "lag", F.try_divide("_s", "_ss").alias("acf"))


def factor_market(macro: DataFrame, returns: DataFrame, market: str) -> DataFrame:
    """factor, correlation with one asset's returns, over dates at which all factors and the market are known."""
    known = complete_dates(macro, "value")
    spot = returns.filter(F.col("asset") == market).select("date", "ret")
    return known.join(spot, "date").groupBy("factor").agg(F.corr("value", "ret").alias("correlation"))


def asset_macro(returns: DataFrame, macro: DataFrame) -> DataFrame:
    return returns.join(macro, "date").groupBy("asset", "factor").agg(F.corr("ret", "value").alias("correlation"))


def describe(panel: DataFrame, key: str = "asset", value: str = "price") -> DataFrame:
    """Count, mean, deviation, least, exact quartiles and greatest."""
    v = F.col(value)
    rest = F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    found = quantiles.aggregated(panel, key, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, *rest)
    return found.select(key, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def histogram(returns: DataFrame, bins: int = 50) -> DataFrame:
    """asset, bin (from 0), n, density, and the normal density at the bin's middle; bins of equal width over each
    series' range, the greatest value in the last."""
    spans = returns.groupBy("asset").agg(F.min("ret").alias("low"), F.max("ret").alias("high"), F.count("ret").alias("total"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"))
    width = (F.col("high") - F.col("low")) / bins
    number = F.least(F.floor(F.try_divide(F.col("ret") - F.col("low"), width)), F.lit(bins - 1)).cast("int")
    counts = returns.join(spans, "asset").withColumns({"bin": number, "width": width}).groupBy("asset", "bin", "low", "width", "total", "mean", "std").agg(F.count("*").alias("n"))
    middle = F.col("low") + (F.col("bin") + 0.5) * F.col("width")
    density = F.try_divide(F.col("n").cast("double"), F.col("total") * F.col("width"))
    return counts.select("asset", "bin", "n", density.alias("density"), stats.normal_pdf(middle, F.col("mean"), F.col("std")).alias("normal_density"))


def quantile_pairs(returns: DataFrame) -> DataFrame:
    """asset, place (from 1), theoretical (the normal quantile of (place - 0.5) / n) and ordered (the standardised value)."""
    own = W.partitionBy("asset")
    z = F.try_divide(F.col("ret") - F.avg("ret").over(own), F.stddev_samp("ret").over(own))
    placed = returns.select("asset", "date", z.alias("ordered"), F.row_number().over(own.orderBy("ret", "date")).alias("place"), F.count("*").over(own).alias("n"))
    return placed.select("asset", "place", stats.normal_ppf((F.col("place") - 0.5) / F.col("n")).alias("theoretical"), "ordered")
