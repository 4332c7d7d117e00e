"""Volatility, tails, drawdowns and performance by asset and for portfolios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import quantiles, stats
from .cleaning import series

#: The standard normal quantile of 5 %.
Z05 = -1.6448536269514729


def volatility(returns: DataFrame, year: int = config.TRADING_DAYS, span: int = 30) -> DataFrame:
    """daily_vol, annual_vol, recent_vol (21 rows), quarterly_vol (63), ewma_vol, upside_vol, downside_vol, vol_ratio and
    vol_of_vol. Rolling values need full windows; half-series deviate about their own mean."""
    root = F.sqrt(F.lit(float(year)))
    w, r = series(), F.col("ret")

    def rolling(rows: int):
        over = w.rowsBetween(1 - rows, 0)
        return F.when(F.count("ret").over(over) == rows, F.stddev_samp("ret").over(over) * root)

    back = F.row_number().over(W.partitionBy("asset").orderBy(F.desc("date"))) - 1
    rows = returns.withColumns({"v21": rolling(21), "v63": rolling(63), "weight": F.pow(F.lit(1 - 2 / (span + 1)), back)})
    weight = F.col("weight")
    sums = rows.groupBy("asset").agg(
        F.stddev_samp(r).alias("daily_vol"),
        F.max_by("v21", "date").alias("recent_vol"),
        F.max_by("v63", "date").alias("quarterly_vol"),
        (F.stddev_samp(F.when(r > 0, r)) * root).alias("upside_vol"),
        (F.stddev_samp(F.when(r < 0, r)) * root).alias("downside_vol"),
        F.try_divide(F.stddev_samp("v21"), F.avg("v21")).alias("vol_of_vol"),
        F.sum(weight).alias("w1"),
        F.sum(weight * weight).alias("w2"),
        F.sum(weight * r).alias("wx"),
        F.sum(weight * r * r).alias("wxx"),
    )
    mean = F.col("wx") / F.col("w1")
    unbiased = F.try_divide(F.col("w1") * F.col("w1"), F.col("w1") * F.col("w1") - F.col("w2"))
    ewma = F.sqrt(F.greatest((F.col("wxx") / F.col("w1") - mean * mean) * unbiased, F.lit(0.0))) * root
    return sums.select(
        "asset",
        "daily_vol",
        (F.col("daily_vol") * root).alias("annual_vol"),
        "recent_vol",
        "quarterly_vol",
        ewma.alias("ewma_vol"),
        "upside_vol",
        "downside_vol",
        F.try_divide("downside_vol", "upside_vol").alias("vol_ratio"),
        "vol_of_vol",
    )


def tail_risk(returns: DataFrame) -> DataFrame:
    """Value at risk at 95 and 99 %, the mean loss beyond each, modified value at risk (excess kurtosis less three and
    the bracket times the quantile, as this operator has always had it), the standard expansion, skewness, kurtosis
    and the greatest loss."""
    r = F.col("ret")
    moments = F.avg(r).alias("mu"), F.stddev_samp(r).alias("sigma"), stats.skew(r).alias("skew"), stats.excess_kurtosis(r).alias("kurtosis"), (-F.min(r)).alias("max_loss")
    base = quantiles.aggregated(returns, "asset", "ret", {"q05": 0.05, "q01": 0.01}, *moments).withColumns({"var_95": -F.col("q05"), "var_99": -F.col("q01")})
    beyond = returns.join(base.select("asset", "var_95", "var_99"), "asset").groupBy("asset")
    cvar = beyond.agg(*((-F.avg(F.when(r <= -F.col(f"var_{p}"), r))).alias(f"cvar_{p}") for p in (95, 99)))
    s, k, z = F.col("skew"), F.col("kurtosis"), F.lit(Z05)
    modified = -(F.col("mu") + z * F.col("sigma") * (1 + s * z / 6 + (k - 3) * z * z / 24 - s * s * z * z * z / 36))
    standard = -(F.col("mu") + F.col("sigma") * (z + s * (z * z - 1) / 6 + k * (z * z * z - 3 * z) / 24 - s * s * (2 * z * z * z - 5 * z) / 36))
    return base.join(cvar, "asset").select("asset", "var_95", "var_99", "cvar_95", "cvar_99", modified.alias("modified_var_95"), standard.alias("cornish_fisher_var_95"), "skew", "kurtosis", "max_loss")


def drawdown_series(prices: DataFrame) -> DataFrame:
    peak = F.max("price").over(series().rowsBetween(W.unboundedPreceding, 0))
    return prices.select("date", "asset", "price", (F.try_divide("price", peak) - 1).alias("drawdown"))


def drawdowns(prices: DataFrame) -> DataFrame:
    """max_drawdown, avg_drawdown (of the dates under water, else 0), the worst one's start (first greatest price up to
    its end), end (first least drawdown), days, recovery_days (null if it never is), underwater_days and their share."""
    dd = drawdown_series(prices)
    under = F.col("drawdown") < 0
    worst = dd.groupBy("asset").agg(
        F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(under, F.col("drawdown"))), F.lit(0.0)).alias("avg_drawdown"),
        F.min_by("date", F.struct("drawdown", "date")).alias("dd_end"),
        F.count_if(under).alias("underwater_days"),
        F.avg(under.cast("double")).alias("underwater_ratio"),
    )
    upto = dd.join(worst.select("asset", "dd_end"), "asset")
    start = upto.filter("date <= dd_end").groupBy("asset").agg(F.min_by("date", F.struct(-F.col("price"), F.col("date"))).alias("dd_start"), F.max("price").alias("start_price"))
    back = upto.join(start, "asset").filter("date >= dd_end AND price >= start_price").groupBy("asset").agg(F.min("date").alias("recovered"))
    found = worst.join(start, "asset").join(back, "asset", "left")
    return found.select(
        "asset", "max_drawdown", "avg_drawdown", "dd_start", "dd_end",
        F.datediff("dd_end", "dd_start").cast("long").alias("duration_days"),
        F.datediff("recovered", "dd_end").cast("long").alias("recovery_days"),
        "underwater_days", "underwater_ratio",
    )


def performance(returns: DataFrame, prices: DataFrame, benchmark: str, rf: float = config.RISK_FREE_RATE, year: int = config.TRADING_DAYS) -> DataFrame:
    """total_return, annual_return (geometric), sharpe (arithmetic), sortino, calmar, information_ratio and
    tracking_error against benchmark on shared dates, positive_ratio and return_vol_ratio."""
    r, root = F.col("ret"), F.sqrt(F.lit(float(year)))
    base = returns.groupBy("asset").agg(
        (F.product(1 + r) - 1).alias("total_return"),
        F.count(r).alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        (F.stddev_samp(F.when(r < 0, r)) * root).alias("down"),
        F.avg((r > 0).cast("double")).alias("positive_ratio"),
    )
    other = returns.filter(F.col("asset") == benchmark).select("date", F.col("ret").alias("bench"))
    active = returns.join(other, "date").groupBy("asset").agg(
        (F.stddev_samp(r - F.col("bench")) * root).alias("tracking_error"), (F.product(1 + r) - 1).alias("own"), (F.product(1 + F.col("bench")) - 1).alias("its"), F.count("*").alias("shared")
    )
    worst = drawdown_series(prices).groupBy("asset").agg(F.min("drawdown").alias("max_drawdown"))
    yearly = lambda total, n: F.pow(1 + total, year / n) - 1
    annual = yearly(F.col("total_return"), F.col("n"))
    excess = yearly(F.col("own"), F.col("shared")) - yearly(F.col("its"), F.col("shared"))
    joined = base.join(active, "asset", "left").join(worst, "asset")
    return joined.select(
        "asset",
        "total_return",
        annual.alias("annual_return"),
        (F.try_divide(F.col("mean") - rf / year, F.col("std")) * root).alias("sharpe"),
        F.try_divide(annual - rf, F.col("down")).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, (annual - rf) / -F.col("max_drawdown")).alias("calmar"),
        F.when(F.col("tracking_error") > 1e-12, excess / F.col("tracking_error")).alias("information_ratio"),
        "tracking_error",
        "positive_ratio",
        F.try_divide(annual, F.col("std") * root).alias("return_vol_ratio"),
    )


def all_metrics(returns: DataFrame, prices: DataFrame, benchmark: str) -> DataFrame:
    """The four groups by asset; a name that two groups share is taken from the first."""
    groups = [volatility(returns), tail_risk(returns), drawdowns(prices), performance(returns, prices, benchmark)]
    return reduce(lambda a, b: a.join(b.drop(*(c for c in b.columns if c in a.columns and c != "asset")), "asset"), groups)


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """date, portfolio, ret: weights (portfolio, asset, weight) made to sum to one over the assets that there are."""
    known = weights.join(returns.select("asset").distinct(), "asset", "left_semi")
    total = F.sum("weight").over(W.partitionBy("portfolio"))
    scaled = known.withColumn("weight", F.try_divide("weight", total))
    return returns.join(scaled, "asset").groupBy("date", "portfolio").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def portfolio_metrics(returns: DataFrame, weights: DataFrame, rf: float = config.RISK_FREE_RATE, year: int = config.TRADING_DAYS) -> DataFrame:
    """Arithmetic annual_return, annual_vol, max_drawdown (of compounded returns, without a point before the first),
    sharpe, sortino, calmar, var_95 and cvar_95 of each portfolio."""
    root, r = F.sqrt(F.lit(float(year))), F.col("ret")
    w = series("portfolio")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    own = portfolio_returns(returns, weights).withColumn("level", F.product(1 + r).over(upto)).withColumn("dd", F.try_divide("level", F.max("level").over(upto)) - 1)
    moments = (F.avg(r) * year).alias("annual_return"), (F.stddev_samp(r) * root).alias("annual_vol"), F.min("dd").alias("max_drawdown"), (F.stddev_samp(F.when(r < 0, r)) * root).alias("down")
    base = quantiles.aggregated(own, "portfolio", "ret", {"q05": 0.05}, *moments).withColumn("var_95", -F.col("q05"))
    cvar = own.join(base.select("portfolio", "var_95"), "portfolio").groupBy("portfolio").agg((-F.avg(F.when(r <= -F.col("var_95"), r))).alias("cvar_95"))
    extra = F.col("annual_return") - rf
    return base.join(cvar, "portfolio").select(
        "portfolio", "annual_return", "annual_vol", "max_drawdown", F.try_divide(extra, F.col("annual_vol")).alias("sharpe"), F.try_divide(extra, F.col("down")).alias("sortino"),
        F.when(F.col("max_drawdown") < 0, extra / -F.col("max_drawdown")).alias("calmar"), "var_95", "cvar_95",
    )


def panel(returns: DataFrame, prices: DataFrame, rf: float = config.RISK_FREE_RATE, year: int = config.TRADING_DAYS) -> DataFrame:
    """asset, annual_return (arithmetic), annual_vol, sharpe, sortino, downside_vol, var_95, cvar_95 and max_drawdown of each
    asset by itself. Where no spread of losses is known (fewer than two), downside_vol is 0 and sortino infinite."""
    root, ret = F.sqrt(F.lit(float(year))), F.col("ret")
    moments = (F.avg(ret) * year).alias("annual_return"), (F.stddev_samp(ret) * root).alias("annual_vol"), (F.stddev_samp(F.when(ret < 0, ret)) * root).alias("down")
    base = quantiles.aggregated(returns, "asset", "ret", {"q05": 0.05}, *moments)
    cvar = returns.join(base.select("asset", "q05"), "asset").groupBy("asset").agg((-F.avg(F.when(ret <= F.col("q05"), ret))).alias("cvar_95"))
    worst = drawdown_series(prices).groupBy("asset").agg(F.min("drawdown").alias("max_drawdown"))
    extra, down = F.col("annual_return") - rf, F.coalesce("down", F.lit(0.0))
    sortino = F.when(down > 0, extra / down).otherwise(F.lit(float("inf")))
    return base.join(cvar, "asset").join(worst, "asset").select(
        "asset", "annual_return", "annual_vol", F.try_divide(extra, F.col("annual_vol")).alias("sharpe"), sortino.alias("sortino"), down.alias("downside_vol"),
        (-F.col("q05")).alias("var_95"), "cvar_95", "max_drawdown",
    )


def simple_summary(returns: DataFrame, rf: float = config.RISK_FREE_RATE, year: int = config.TRADING_DAYS) -> DataFrame:
    """asset, annual_return, annual_vol and sharpe, all arithmetic, with each asset's place by sharpe."""
    base = returns.groupBy("asset").agg((F.avg("ret") * year).alias("annual_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(year)))).alias("annual_vol"))
    ranked = base.withColumn("sharpe", F.try_divide(F.col("annual_return") - rf, F.col("annual_vol")))
    return ranked.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last("sharpe"), "asset")))  # a row an asset


def high_volatility(returns: DataFrame, above: float = 0.25) -> DataFrame:
    return volatility(returns).filter(F.col("annual_vol") > above).select("asset", "annual_vol")
