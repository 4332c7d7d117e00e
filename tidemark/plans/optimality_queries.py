"""What the small programs' weights must satisfy, as columns that SQL restates: sums, bounds, targets that SQL computes from
the data, and the gap to the optimum, which is zero."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import black_litterman as B
from ..operators import factors as X
from ..operators import optimize as O
from .portfolio_queries import MOMENTS, _model, _views
from .registry import query, r
from .validation_queries import weekly_returns

#: Gaps under this are none: the programs stop at some 1e-9 of their scale.
GAP = 1e-5


def _certified(name: str) -> str:
    return f"SELECT '{name}' AS portfolio, 1.0::DOUBLE AS budget, true AS bounded, true AS optimal"


def _certificate(weights: DataFrame, mu: DataFrame, cov: DataFrame, slope, low: float = 0.0, high: float = 1.0) -> DataFrame:
    found = O.optimality(weights, mu, cov, slope, low, high)
    return found.select("portfolio", "budget", "bounded", F.col("gap").between(-GAP, GAP).alias("optimal"))


def _frames(spark: SparkSession, names: list[str], mu: np.ndarray, cov: np.ndarray) -> tuple[DataFrame, DataFrame]:
    means = spark.createDataFrame([(k, float(x)) for k, x in zip(names, mu, strict=True)], "asset string, mu double")
    pairs = [(a, b, float(cov[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
    return means, spark.createDataFrame(pairs, "asset_i string, asset_j string, cov double")


@query(_certified("max_sharpe"))
def portfolio_max_sharpe_optimality(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    return _certificate(O.max_sharpe(returns), *O.moments(returns), O.sharpe_slope())


@query(_certified("min_volatility"))
def portfolio_min_volatility_optimality(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    return _certificate(O.min_volatility(returns), *O.moments(returns), O.least_variance_slope)


@query(f"WITH {MOMENTS} SELECT asset, {r('1.0 / count(*) OVER ()', 'risk_share')}, {r('1.0', 'budget')} FROM mu")
def portfolio_risk_parity_shares(spark: SparkSession, d: str) -> DataFrame:
    """Every asset's part of the risk, computed anew from the weights and the covariances, is the same."""
    returns = weekly_returns(spark, d)
    weights = O.risk_parity(returns).select("portfolio", "asset", "weight")
    _, cov = O.moments(returns)
    other = weights.select(F.col("asset").alias("asset_j"), F.col("weight").alias("wj"))
    risk = cov.join(other, "asset_j").groupBy(F.col("asset_i").alias("asset")).agg(F.sum(F.col("cov") * F.col("wj")).alias("risk"))
    total = weights.join(risk, "asset").agg(F.sum(F.col("weight") * F.col("risk")).alias("total"), F.sum("weight").alias("budget"))
    shares = weights.join(risk, "asset").crossJoin(F.broadcast(total))  # one row
    return shares.select("asset", (F.col("weight") * F.col("risk") / F.col("total")).alias("risk_share"), "budget")


@query(f"WITH {MOMENTS} SELECT {r('(min(mu) + max(mu)) / 2', 'expected_return')}, {r('1.0', 'budget')}, true AS bounded FROM mu")
def portfolio_target_return_reached(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    mu, _ = O.moments(returns)
    target = mu.agg((F.min("mu") + F.max("mu")) / 2).first()[0]
    bounded = F.min((F.col("weight") >= -1e-9) & (F.col("weight") <= 1 + 1e-9))
    return O.target_return(returns, target).join(mu, "asset").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"), F.sum("weight").alias("budget"), bounded.alias("bounded"))


@query("SELECT CAST(range AS INTEGER) AS point, 1.0::DOUBLE AS budget, true AS rises, true AS even FROM range(20)")
def portfolio_frontier_curve_shape(spark: SparkSession, d: str) -> DataFrame:
    """Targets are even steps, and volatility doesn't fall along them."""
    points = O.frontier_curve(weekly_returns(spark, d)).groupBy("point").agg(F.sum("weight").alias("budget"), F.first("expected_return").alias("mean"), F.first("volatility").alias("risk"))
    ends = points.agg(F.min("mean").alias("least"), F.max("mean").alias("most"))
    before = points.select((F.col("point") + 1).alias("point"), F.col("risk").alias("was"))
    joined = points.join(before, "point", "left").crossJoin(F.broadcast(ends))  # one row
    even = F.abs(F.col("mean") - F.col("least") - F.col("point") * (F.col("most") - F.col("least")) / 19) < 1e-7
    return joined.select("point", "budget", F.coalesce(F.col("risk") >= F.col("was") - 1e-9, F.lit(True)).alias("rises"), even.alias("even"))


BL_SLOPES = {"sharpe": O.sharpe_slope(), "min_variance": O.least_variance_slope, "utility": O.utility_slope(1.0)}


def _bl(objective: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        mu, cov = O.moments(weekly_returns(spark, d))
        names, _, mean, spread = B.posterior(mu, cov, _views(sorted(x["asset"] for x in mu.select("asset").collect())))
        weights = B.optimise(mu, cov, _views(names), objective)
        return _certificate(weights, *_frames(spark, names, mean, spread), BL_SLOPES[objective], config.MIN_WEIGHT, config.MAX_WEIGHT)

    run.__name__ = f"bl_optimise_{objective}_optimality"
    return run


for _objective in BL_SLOPES:
    query(_certified(f"bl_{_objective}"))(_bl(_objective))


def _factor(objective: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        returns, m = _model(spark, d)
        weights = X.optimise(returns, m, objective)
        return _certificate(weights, *_frames(spark, m.assets, m.expected(), m.covariance()), BL_SLOPES[objective], config.MIN_WEIGHT, config.MAX_WEIGHT)

    run.__name__ = f"factor_optimise_{objective}_optimality"
    return run


for _objective in BL_SLOPES:
    query(_certified(f"factor_{_objective}"))(_factor(_objective))


@query(f"WITH {MOMENTS} SELECT {r('avg(mu)', 'expected_return')}, {r('1.0', 'budget')}, true AS bounded FROM mu")
def factor_optimise_efficient_return_reached(spark: SparkSession, d: str) -> DataFrame:
    """With a constant in the regression the model's means are the samples'; the target is their average."""
    returns, m = _model(spark, d)
    weights = X.optimise(returns, m, "efficient_return", target=float(m.expected().mean()))
    bounded = F.min((F.col("weight") >= config.MIN_WEIGHT - 1e-9) & (F.col("weight") <= config.MAX_WEIGHT + 1e-9))
    return weights.join(O.moments(returns)[0], "asset").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"), F.sum("weight").alias("budget"), bounded.alias("bounded"))
