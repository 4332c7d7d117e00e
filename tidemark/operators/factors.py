"""Factor returns, exposures by least squares, and portfolios by factor risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import solvers
from .cleaning import complete_dates
from .optimize import Limits, weights_frame, within


def _sides(ranked: DataFrame, share: float) -> DataFrame:
    """asset, side: 1 for the share of assets with the greatest score, -1 for the least."""
    n = F.floor(share * F.count("*").over(W.partitionBy()))
    top = F.row_number().over(W.orderBy(F.desc("score"), "asset"))
    low = F.row_number().over(W.orderBy("score", "asset"))
    # a row an asset
    return ranked.filter("score IS NOT NULL").withColumns({"n": n, "top": top, "low": low}).select("asset", F.when(F.col("top") <= F.col("n"), 1).when(F.col("low") <= F.col("n"), -1).alias("side")).filter("side IS NOT NULL")


def _spread(returns: DataFrame, sides: DataFrame, factor: str, sign: int = 1) -> DataFrame:
    long, short = F.avg(F.when(F.col("side") == 1, F.col("ret"))), F.avg(F.when(F.col("side") == -1, F.col("ret")))
    return returns.join(sides, "asset").groupBy("date").agg((sign * (long - short)).alias("value")).select("date", F.lit(factor).alias("factor"), "value")


def factor_returns(returns: DataFrame, share: float = 0.3, lookback: int = 252) -> DataFrame:
    """date, factor, value: MKT the mean of assets; SMB high less low volatility; VOL its opposite; MOM last winners
    less losers by the mean over the last rows (lookback, half the history at most), one ranking for all dates."""
    market = returns.groupBy("date").agg(F.avg("ret").alias("value")).select("date", F.lit("MKT").alias("factor"), "value")
    spread = _sides(returns.groupBy("asset").agg(F.stddev_samp("ret").alias("score")), share)
    numbered = returns.withColumns({"back": F.row_number().over(W.partitionBy("asset").orderBy(F.desc("date"))), "n": F.count("*").over(W.partitionBy("asset"))})
    recent = numbered.filter(F.col("back") <= F.least(F.lit(lookback), F.floor(F.col("n") / 2))).groupBy("asset").agg(F.avg("ret").alias("score"))
    parts = [market, _spread(returns, spread, "SMB"), _spread(returns, _sides(recent, share), "MOM"), _spread(returns, spread, "VOL", -1)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


@dataclass
class Exposures:
    """What a regression leaves: loadings (assets by factors, the constant first), factor means and covariances (a day),
    and residual variances."""

    assets: list[str]
    factors: list[str]
    beta: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    residual: np.ndarray

    def expected(self, year: int = config.TRADING_DAYS) -> np.ndarray:
        return self.beta @ self.mean * year

    def covariance(self, year: int = config.TRADING_DAYS) -> np.ndarray:
        return solvers.positive_definite((self.beta @ self.cov @ self.beta.T + np.diag(self.residual)) * year)


def cross_products(returns: DataFrame, factors: DataFrame) -> tuple[list[str], DataFrame]:
    """Factor names (a constant first), and for each asset the normal equations over dates that all factors have: the
    products of every two factors (xx_i_j, i <= j), of each with the return (xy_i), and the return's square (yy)."""
    names = ["const", *sorted(r["factor"] for r in factors.select("factor").distinct().collect())]  # a name a factor
    wide = factors.groupBy("date").pivot("factor", names[1:]).agg(F.first("value")).na.drop().withColumn("const", F.lit(1.0))
    x = [F.col(f"`{k}`") for k in names]
    pairs = [F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    own = [F.sum(a * F.col("ret")).alias(f"xy_{i}") for i, a in enumerate(x)]
    return names, returns.join(wide, "date").groupBy("asset").agg(*pairs, *own, F.sum(F.col("ret") * F.col("ret")).alias("yy"))


def estimate(returns: DataFrame, factors: DataFrame) -> Exposures:
    """Least squares with a constant, of least norm where factors are dependent; residual variance over the rows less
    the rank. Sums are Spark's, a row an asset; the matrices are of factors. Factor moments are those of the asset with
    the most rows."""
    names, sums = cross_products(returns, factors)
    rows = sorted(sums.collect(), key=lambda r: r["asset"])
    k = len(names)
    assets, beta, residual, best = [], [], [], None
    for row in rows:
        xx = np.array([[row[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        xy = np.array([row[f"xy_{i}"] for i in range(k)])
        own = np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ xy
        rank = np.linalg.matrix_rank(xx, hermitian=True, tol=1e-10 * np.linalg.norm(xx, 2))
        assets.append(row["asset"])
        beta.append(own)
        residual.append(max(row["yy"] - own @ xy, 0.0) / (xx[0, 0] - rank))
        best = xx if best is None or xx[0, 0] > best[0, 0] else best
    n = best[0, 0]
    mean = best[0] / n
    return Exposures(assets, names, np.array(beta), mean, (best - n * np.outer(mean, mean)) / (n - 1), np.array(residual))


def optimise(returns: DataFrame, model: Exposures, objective: str = "sharpe", aversion: float = 1.0, target: float | None = None, rf: float = config.RISK_FREE_RATE, low: float = config.MIN_WEIGHT, high: float = config.MAX_WEIGHT, equal: list[tuple[dict[str, float], float]] = (), limits: Limits | None = None) -> DataFrame:
    """Weights by factor moments; equal holds linear equalities ({asset: coefficient}, value), limits inequalities and
    bounds of single assets. No rows if no weights fit."""
    m, s = model.expected(), model.covariance()
    rows = np.array([[c.get(k, 0.0) for k in model.assets] for c, _ in equal]).reshape(-1, len(m))
    extra = (rows, np.array([v for _, v in equal]))
    if limits is not None:
        kind = objective
        if objective == "efficient_return" and target is not None:
            kind, extra = "min_variance", (np.vstack([rows, m]), np.append(extra[1], target))
        w = within(model.assets, m, s, kind, limits, low, high, rf, aversion, extra)
        return weights_frame(returns.sparkSession, f"factor_{objective}", model.assets, w)
    if objective == "sharpe":
        w = solvers.max_sharpe(m, s, rf, low, high, extra)
    elif objective == "min_variance":
        w = solvers.min_variance(s, low, high, extra)
    elif objective == "utility":
        a, b = np.vstack([np.ones(len(m)), rows]), np.append(1.0, extra[1])
        w = solvers.quadratic(aversion * s, -m, a, b, *solvers.box(len(m), low, high))
    elif objective == "efficient_return" and target is not None:
        w = solvers.min_variance(s, low, high, (np.vstack([rows, m]), np.append(extra[1], target)))
    else:
        raise ValueError(f"no objective {objective}, or no target")
    return weights_frame(returns.sparkSession, f"factor_{objective}", model.assets, w)


def tilted(returns: DataFrame, model: Exposures, targets: dict[str, float], objective: str = "min_tracking_error", benchmark: dict[str, float] | None = None, low: float = config.MIN_WEIGHT, high: float = config.MAX_WEIGHT) -> tuple[DataFrame, str]:
    """Weights with given exposures to known factors, and a status: optimal, or infeasible with no rows."""
    known = [k for k in targets if k in model.factors]
    rows = np.array([model.beta[:, model.factors.index(k)] for k in known]).reshape(-1, len(model.assets))
    extra = (rows, np.array([targets[k] for k in known]))
    s, n = model.covariance(), len(model.assets)
    if objective == "max_return":
        w = solvers.linear_max(model.expected(), low, high, extra)
    elif objective == "min_variance":
        w = solvers.min_variance(s, low, high, extra)
    elif objective == "min_tracking_error":
        bench = np.array([(benchmark or {}).get(k, 0.0 if benchmark else 1.0 / n) for k in model.assets])
        a, b = np.vstack([np.ones(n), rows]), np.append(1.0, extra[1])
        w = solvers.quadratic(s, -s @ bench, a, b, *solvers.box(n, low, high))
    else:
        raise ValueError(f"no objective {objective}")
    return weights_frame(returns.sparkSession, f"tilt_{objective}", model.assets, w), "infeasible" if w is None else "optimal"


def portfolio_exposures(returns: DataFrame, weights: DataFrame, model: Exposures) -> DataFrame:
    """portfolio, factor, exposure of weights made to sum to one over the model's assets."""
    spark = returns.sparkSession
    rows = [(k, f, float(model.beta[i, j])) for i, k in enumerate(model.assets) for j, f in enumerate(model.factors)]
    loadings = spark.createDataFrame(rows, "asset string, factor string, beta double")
    known = weights.join(loadings.select("asset").distinct(), "asset", "left_semi")
    scaled = known.withColumn("weight", F.try_divide("weight", F.sum("weight").over(W.partitionBy("portfolio"))))
    return scaled.join(loadings, "asset").groupBy("portfolio", "factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("exposure"))
