"""Runs of several operators at once, each a table with a column that says which."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import solvers
from ..sources import files
from . import backtest, black_litterman, factors, optimize, simulate
from .black_litterman import View

# Default macro rules, as (factor, threshold in its own unit, side, {asset: weight}), first match first.
DEFAULT_RULES = (
    ("FEDFUNDS", 3.0, "above", {"TLT": 0.8, "SPY": 0.2}),
    ("FEDFUNDS", 3.0, "below", {"SPY": 0.7, "QQQ": 0.3}),
    ("CPIAUCSL_YOY", 4.0, "above", {"GLD": 0.3, "TIP": 0.3, "SPY": 0.4}),
    ("CPIAUCSL_YOY", 4.0, "below", {"SPY": 0.6, "TLT": 0.4}),
    ("VIX", 25.0, "above", {"TLT": 0.6, "SPY": 0.2, "GLD": 0.2}),
    ("VIX", 25.0, "below", {"SPY": 0.7, "QQQ": 0.3}),
)
#: Default tilts: targets of exposures and what is sought.
TILTS = (({"MOM": -0.2}, "max_return"), ({"MOM": 0.2}, "max_return"), ({"VOL": 0.2}, "min_variance"), ({"MKT": 1.0, "SMB": 0.2, "MOM": 0.2, "VOL": 0.2}, "min_tracking_error"))


def default_rules(macro: DataFrame, year: int = 252) -> tuple[DataFrame, DataFrame]:
    """macro with the yearly change of consumer prices (per cent) as a factor of its own, and the default rules of the
    factors that it has, as macro_weights() takes them."""
    prices = macro.filter("factor = 'CPIAUCSL'")
    derived = backtest.derived_factor(prices, "pct_change_yoy", year).withColumn("factor", F.lit("CPIAUCSL_YOY"))
    every = macro.unionByName(derived.select(*macro.columns))
    order = list(dict.fromkeys(r[0] for r in DEFAULT_RULES))
    rows = [(order.index(f) + 1, f, t, side, asset, w) for f, t, side, action in DEFAULT_RULES for asset, w in action.items()]
    rules = macro.sparkSession.createDataFrame(rows, "priority int, factor string, threshold double, side string, asset string, weight double")
    return every, rules.join(every.select("factor").distinct(), "factor", "left_semi").select(*rules.columns)


def optimizations(returns: DataFrame, random: int = 5000, points: int = 30, targets: int = 10, rf: float = config.RISK_FREE_RATE) -> tuple[DataFrame, DataFrame]:
    """portfolio, asset, weight of the named portfolios, of those at targets even returns and of the curve's points; and
    the random portfolios' moments. The statistics are computed once."""
    spark = returns.sparkSession
    mu, cov = optimize.moments(returns)
    names, m, s = optimize.arrays(mu, cov)
    held = {"max_sharpe": solvers.max_sharpe(m, s, rf), "min_volatility": solvers.min_variance(s), "risk_parity": solvers.risk_parity(s)}
    safe = float(held["min_volatility"] @ m)
    for kind, top, n in (("target", m.max(), targets), ("curve", 0.9 * m.max(), points)):
        held |= {f"{kind}_{k}": w for k, w in enumerate(optimize.on_frontier(m, s, np.linspace(safe, top, n)))}
    rows = [(k, name, float(x) if abs(x) > 1e-12 else 0.0) for k, w in held.items() if w is not None for name, x in zip(names, w, strict=True)]
    return spark.createDataFrame(rows, optimize.WEIGHTS), optimize.portfolio_moments(optimize.random_weights(mu, random), mu, cov, rf)


def factor_portfolios(returns: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """portfolio, asset, weight, status of the two standard objectives and the default tilts, by cached factor returns
    if they have more than ten dates with returns, else by factors made from them."""
    known = None if cached is None else cached.join(returns.select("date").distinct(), "date", "left_semi")
    use = known if known is not None and known.select("date").distinct().count() > 10 else factors.factor_returns(returns)
    model = factors.estimate(returns, use)
    found = [factors.optimise(returns, model, o).withColumn("status", F.lit("optimal")) for o in ("sharpe", "min_variance")]
    for k, (targets, objective) in enumerate(TILTS):
        frame, status = factors.tilted(returns, model, targets, objective)
        found.append(frame.withColumn("portfolio", F.lit(f"tilt_{k}")).withColumn("status", F.lit(status)))
    return reduce(DataFrame.unionByName, found)


def view_sets(names: list[str]) -> dict[str, list[View]]:
    """Example sets of views on the first assets: none, one, absolute ones, relative ones, and both."""
    absolute = [View.absolute(a, 0.12 + 0.01 * k, 0.7 - 0.1 * k) for k, a in enumerate(names[:3])]
    relative = [View.relative(names[0], names[3], 0.05, 0.6), *([View.relative(names[1], names[4], 0.03, 0.7)] if len(names) > 4 else [])] if len(names) > 3 else []
    return {"equilibrium": [], "one": [View.absolute(names[0], 0.15, 0.8)], "absolute": absolute, "relative": relative, "both": absolute + relative}


def view_portfolios(returns: DataFrame, objective: str = "sharpe") -> DataFrame:
    """views, asset, weight for each example set."""
    mu, cov = optimize.moments(returns)
    names = sorted(r["asset"] for r in mu.select("asset").collect())  # a name an asset
    found = [black_litterman.optimise(mu, cov, v, objective).select(F.lit(k).alias("views"), "asset", "weight") for k, v in view_sets(names).items()]
    return reduce(DataFrame.unionByName, found)


def default_weights(returns: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """asset, weight: saved ones if they have rows, else equal parts of the assets that there are."""
    if saved is not None and not saved.isEmpty():
        return saved.select("asset", "weight")
    names = returns.select("asset").distinct()
    return names.crossJoin(names.agg((F.lit(1.0) / F.count("*")).alias("weight")))  # one row


def available_history(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """date, ret: on each date the weights are made to sum to one over the assets that have a return then."""
    joined = returns.filter("ret IS NOT NULL").join(weights.select("asset", "weight"), "asset")
    own = W.partitionBy("date")
    scaled = joined.withColumn("part", F.try_divide("weight", F.sum("weight").over(own)))
    return scaled.groupBy("date").agg(F.sum(F.col("part") * F.col("ret")).alias("ret"))


def simulation(history: DataFrame, cache: str, method: str = "parametric", paths: int = 1000, horizon: int = 1260, initial: float = config.INITIAL_INVESTMENT, seed: str = "mc") -> DataFrame:
    """final_stats of simulated paths, kept at cache under all parameters and the history itself."""
    run = getattr(simulate, method)
    parameters = {"method": method, "paths": paths, "horizon": horizon, "initial": initial, "seed": seed}
    build = lambda: simulate.final_stats(run(history, paths, horizon, initial=initial, seed=seed), initial)
    return files.cached(history.sparkSession, cache, parameters, history, build)


def backtests(prices: DataFrame, returns: DataFrame, strategies: DataFrame, macro: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """strategy and its metrics: strategies rebalanced monthly; momentum from its first weights on; and, with a macro panel,
    the weights of its rules (the default ones, if none are given), traded at each month's first close from the first
    month with weights on. A panel that no rule knows leaves that one out."""
    static = backtest.rebalanced(prices, strategies, backtest.month_end_dates(prices))
    found = [static, moving(prices, backtest.momentum_weights(returns, backtest.previous_dates(prices)))]
    if macro is not None:
        every, own = default_rules(macro) if rules is None else (macro, rules)
        firsts = prices.groupBy(F.trunc("date", "MM").alias("month")).agg(F.min("date").alias("traded"))
        targets = backtest.macro_weights(every, own)
        last = W.partitionBy("month").orderBy(F.desc("date"))  # of several dates of a month the last
        monthly = targets.withColumn("month", F.trunc("date", "MM")).withColumn("place", F.dense_rank().over(last)).filter("place = 1")
        found.append(moving(prices, monthly.join(firsts, "month").select("strategy", F.col("traded").alias("date"), "asset", "weight")))
    return backtest.backtest_metrics(reduce(DataFrame.unionByName, [f.select(*static.columns) for f in found]))


def moving(prices: DataFrame, weights: DataFrame) -> DataFrame:
    """A strategy of changing weights (strategy, date, asset, weight), from its first date on."""
    begin = weights.agg(F.min("date").alias("begin"))
    later = prices.crossJoin(F.broadcast(begin)).filter("date >= begin").drop("begin")  # one row
    return backtest.rebalanced(later, weights, weights.select("strategy", "date").distinct())
