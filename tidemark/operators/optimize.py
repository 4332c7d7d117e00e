"""Mean-variance and risk-parity portfolios: statistics and random portfolios in Spark, small programs on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import programs, solvers, stats
from .gram import means_of, pair_stats

WEIGHTS = "portfolio string, asset string, weight double"


def moments(returns: DataFrame, year: int = config.TRADING_DAYS) -> tuple[DataFrame, DataFrame]:
    """asset, mu (computed at once: a number an asset) and asset_i, asset_j, cov, both for a year."""
    means = means_of(returns)
    mu = returns.sparkSession.createDataFrame([(k, v * year) for k, v in means.items()], "asset string, mu double")
    return mu, pair_stats(returns, means=means).select("asset_i", "asset_j", (F.col("cov") * year).alias("cov"))


def arrays(mu: DataFrame, cov: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names in order, vector and matrix, on the driver: as many numbers as there are pairs of assets."""
    own = {r["asset"]: r["mu"] for r in mu.collect()}
    names = sorted(own)
    at = {k: i for i, k in enumerate(names)}
    sigma = np.zeros((len(names), len(names)))
    for r in cov.collect():
        sigma[at[r["asset_i"]], at[r["asset_j"]]] = r["cov"]
    return names, np.array([own[k] for k in names]), sigma


def weights_frame(spark: SparkSession, portfolio: str, names: list[str], w: np.ndarray | None) -> DataFrame:
    """portfolio, asset, weight; no rows for a program without a solution; weights under 1e-12 are zero."""
    rows = [] if w is None else [(portfolio, k, float(x) if abs(x) > 1e-12 else 0.0) for k, x in zip(names, w, strict=True)]
    return spark.createDataFrame(rows, WEIGHTS)


def portfolio_moments(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = config.RISK_FREE_RATE, key: str = "portfolio") -> DataFrame:
    """key, expected_return, volatility, sharpe from weights and moments."""
    mean = weights.join(mu, "asset").groupBy(key).agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"))
    left = weights.select(key, F.col("asset").alias("asset_i"), F.col("weight").alias("wi"))
    right = weights.select(key, F.col("asset").alias("asset_j"), F.col("weight").alias("wj"))
    risk = left.join(cov, "asset_i").join(right, [key, "asset_j"]).groupBy(key).agg(F.sqrt(F.sum(F.col("wi") * F.col("wj") * F.col("cov"))).alias("volatility"))
    joined = mean.join(risk, key)
    return joined.withColumn("sharpe", F.try_divide(F.col("expected_return") - rf, F.col("volatility")))


def random_weights(mu: DataFrame, n: int, seed: str = "frontier") -> DataFrame:
    """portfolio (from 0), asset, weight: uniform draws hashed from portfolio and asset, made to sum to one."""
    ids = mu.sparkSession.range(n).withColumnRenamed("id", "portfolio")
    names = mu.agg(F.array_sort(F.collect_set("asset")).alias("names"))
    draws = ids.crossJoin(F.broadcast(names)).select("portfolio", F.explode("names").alias("asset"))  # one row
    draws = draws.withColumn("u", stats.uniform(seed, F.col("portfolio"), F.col("asset")))
    totals = draws.groupBy("portfolio").agg(F.sum("u").alias("total"))
    return draws.join(totals, "portfolio").select("portfolio", "asset", (F.col("u") / F.col("total")).alias("weight"))


def random_frontier(returns: DataFrame, n: int = 100, seed: str = "frontier") -> DataFrame:
    mu, cov = moments(returns)
    return portfolio_moments(random_weights(mu, n, seed), mu, cov)


def best_of(frontier: DataFrame) -> DataFrame:
    """The portfolios of least volatility and greatest sharpe, the first on ties."""
    low = frontier.orderBy("volatility", "portfolio").limit(1).select(F.lit("min_volatility").alias("kind"), "*")
    return low.unionByName(frontier.orderBy(F.desc("sharpe"), "portfolio").limit(1).select(F.lit("max_sharpe").alias("kind"), "*"))


def solve(returns: DataFrame, portfolio: str, program: Callable[..., np.ndarray | None], named: bool = False) -> DataFrame:
    """The weights of program(means, covariances), or of program(means, covariances, names)."""
    mu, cov = moments(returns)
    names, m, s = arrays(mu, cov)
    return weights_frame(returns.sparkSession, portfolio, names, program(m, s, names) if named else program(m, s))


def max_sharpe(returns: DataFrame, rf: float = config.RISK_FREE_RATE) -> DataFrame:
    return solve(returns, "max_sharpe", lambda m, s: solvers.max_sharpe(m, s, rf))


def min_volatility(returns: DataFrame) -> DataFrame:
    return solve(returns, "min_volatility", lambda m, s: solvers.min_variance(s))


def target_return(returns: DataFrame, target: float) -> DataFrame:
    """The least volatility at a return; no rows if no weights reach it."""
    return solve(returns, "target_return", lambda m, s: solvers.min_variance(s, extra=(m[None, :], np.array([target]))))


def risk_parity(returns: DataFrame, budget: list[float] | None = None) -> DataFrame:
    """portfolio, asset, weight and risk_share."""
    mu, cov = moments(returns)
    names, _, s = arrays(mu, cov)
    w = solvers.risk_parity(s, None if budget is None else np.array(budget))
    rows = [("risk_parity", k, float(x), float(y)) for k, x, y in zip(names, w, solvers.risk_shares(w, s), strict=True)]
    return returns.sparkSession.createDataFrame(rows, f"{WEIGHTS}, risk_share double")


def frontier_corners(returns: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """corner (0 the greatest mean), asset, weight, expected_return, volatility, and price: what a unit of mean is worth in
    half the variance, 0 at the least variance. Every efficient portfolio is on a line between neighbouring corners."""
    mu, cov = moments(returns)
    names, m, s = arrays(mu, cov)
    rows = []
    for k, c in enumerate(programs.corners(m, s, *solvers.box(len(m), low, high))):
        rows += [(k, n, float(x), float(c.weights @ m), float(np.sqrt(c.weights @ s @ c.weights)), c.price) for n, x in zip(names, c.weights, strict=True)]
    return returns.sparkSession.createDataFrame(rows, "corner int, asset string, weight double, expected_return double, volatility double, price double")


def frontier_curve(returns: DataFrame, points: int = 20) -> DataFrame:
    """point, asset, weight, expected_return, volatility for targets from the least-volatility return to 0.9 times the
    greatest mean, between the frontier's corners (those of the lower half, if the targets fall); targets without a
    solution have no rows."""
    mu, cov = moments(returns)
    names, m, s = arrays(mu, cov)
    safe = float(solvers.min_variance(s) @ m)
    rows = []
    for k, w in enumerate(on_frontier(m, s, np.linspace(safe, 0.9 * float(m.max()), points))):
        if w is not None:
            rows += [(k, n, float(x), float(w @ m), float(np.sqrt(w @ s @ w))) for n, x in zip(names, w, strict=True)]
    return returns.sparkSession.createDataFrame(rows, "point int, asset string, weight double, expected_return double, volatility double")


def on_frontier(m: np.ndarray, s: np.ndarray, targets: np.ndarray) -> list[np.ndarray | None]:
    """The long-only weights of least variance at each mean, on the frontier's critical lines (those of its lower half for
    means below the least variance's); None where no weights have the mean."""
    bounds = solvers.box(len(m), 0.0, 1.0)
    upper = programs.corners(m, s, *bounds)
    safe = float(upper[-1].weights @ m)
    lower = programs.corners(-m, s, *bounds) if min(targets) < safe else []
    return [programs.at_mean(upper, m, t) if t >= safe - 1e-12 * (1 + abs(safe)) else programs.at_mean(lower, -m, -t) for t in targets]


@dataclass
class Limits:
    """Inequalities on weights: groups as ({asset: coefficient}, most), each sum at most its value; turnover as (held
    weights, most): the sum of changes from them; bounds of single assets as {asset: (low, high)}."""

    groups: list[tuple[dict[str, float], float]] = field(default_factory=list)
    turnover: tuple[dict[str, float], float] | None = None
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)


def within(names: list[str], m: np.ndarray, s: np.ndarray, objective: str, limits: Limits, low: float = 0.0, high: float = 1.0, rf: float = config.RISK_FREE_RATE, aversion: float = 1.0, equal: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray | None:
    """The weights of an objective (min_variance, utility, max_return, sharpe) within limits; None if none fit, and for
    sharpe also if none that fit earn more than rf."""
    n = len(names)
    below = (np.array([[c.get(k, 0.0) for k in names] for c, _ in limits.groups]).reshape(-1, n), np.array([v for _, v in limits.groups], float))
    pairs = [limits.bounds.get(k, (low, high)) for k in names]
    lower, upper = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    rows = np.vstack([np.ones(n), *([equal[0]] if equal else [])])
    both = rows, np.append(1.0, equal[1] if equal else [])
    held, most = (None, 0.0) if limits.turnover is None else (np.array([limits.turnover[0].get(k, 0.0) for k in names]), limits.turnover[1])

    def solve(caps: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
        if objective == "min_variance":
            return programs.program(s, np.zeros(n), both, caps, lower, upper).x
        if objective == "utility":
            return programs.program(aversion * s, -m, both, caps, lower, upper).x
        if objective == "max_return":
            return programs.linear(-m, both, caps, lower, upper)
        if objective == "sharpe":
            return programs.max_sharpe(m, s, rf, lower, upper, equal, caps)
        raise ValueError(f"no objective {objective}")

    return programs.with_turnover(solve, n, below, held, most)


def limited(returns: DataFrame, objective: str, limits: Limits, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """portfolio, asset, weight within limits; no rows if no weights fit."""
    return solve(returns, f"limited_{objective}", lambda m, s, names: within(names, m, s, objective, limits, low, high), True)


def capital_market_line(best: DataFrame, highest: float, rf: float = config.RISK_FREE_RATE, points: int = 100) -> DataFrame:
    """x, y from (0, rf) through the best portfolio (expected_return, volatility; one row), to 1.2 times highest."""
    grid = best.sparkSession.range(points).select((F.col("id") * (1.2 * highest / (points - 1))).alias("x"))
    slope = F.try_divide(F.col("expected_return") - rf, F.col("volatility"))
    return grid.crossJoin(F.broadcast(best.select(slope.alias("slope")))).select("x", (F.lit(rf) + F.col("slope") * F.col("x")).alias("y"))  # one row


def held(weights: DataFrame, above: float = 0.001) -> DataFrame:
    return weights.filter(F.col("weight") > above)


def optimality(weights: DataFrame, mu: DataFrame, cov: DataFrame, slope: Callable[[Column, Column, Column, Column], Column], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """portfolio, budget (the sum of weights), bounded, gap: what weights between low and high could still gain.

    slope gives the slope of a convex loss in an asset's weight from its mean, its covariance with the portfolio, and the
    portfolio's mean and variance. No feasible weights lose less than the linear program that fills the assets of the
    least slope first: the gap is the slope's drop from the weights to those, zero at the optimum."""
    risk = weights.join(cov, weights.asset == cov.asset_j).groupBy("portfolio", "asset_i").agg(F.sum(F.col("weight") * F.col("cov")).alias("risk"))
    own = risk.withColumnRenamed("asset_i", "asset").join(mu, "asset").join(weights, ["portfolio", "asset"])
    of = W.partitionBy("portfolio")
    sums = {"mean": F.sum(F.col("weight") * F.col("mu")).over(of), "variance": F.sum(F.col("weight") * F.col("risk")).over(of), "n": F.count("*").over(of)}
    sloped = own.withColumns(sums).withColumn("slope", slope(F.col("mu"), F.col("risk"), F.col("mean"), F.col("variance")))
    place = F.row_number().over(of.orderBy("slope", "asset")) - 1
    room = F.lit(1.0) - F.col("n") * low - place * (high - low)
    best = F.lit(low) + F.greatest(F.lit(0.0), F.least(F.lit(high - low), room))
    ends = sloped.withColumn("best", best).groupBy("portfolio")
    bounded = F.min((F.col("weight") >= low - 1e-9) & (F.col("weight") <= high + 1e-9))
    return ends.agg(F.sum("weight").alias("budget"), bounded.alias("bounded"), F.sum(F.col("slope") * (F.col("weight") - F.col("best"))).alias("gap"))


def least_variance_slope(mu: Column, risk: Column, mean: Column, variance: Column) -> Column:
    return risk / variance


def sharpe_slope(rf: float = config.RISK_FREE_RATE) -> Callable[[Column, Column, Column, Column], Column]:
    return lambda mu, risk, mean, variance: ((mean - rf) * risk / variance - mu) / F.sqrt(variance)


def utility_slope(aversion: float) -> Callable[[Column, Column, Column, Column], Column]:
    return lambda mu, risk, mean, variance: aversion * risk - mu
