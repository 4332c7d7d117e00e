"""Equilibrium returns, investor views, and the posterior that joins them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import solvers
from .optimize import arrays, weights_frame


def market_weights(mu: DataFrame, given: dict[str, float] | None = None) -> DataFrame:
    """asset, weight: equal parts, or given ones made to sum to one (equal if they sum to zero)."""
    names = mu.select("asset")
    total = sum(given.values()) if given else 0
    if total:
        known = names.sparkSession.createDataFrame([(k, v / total) for k, v in given.items()], "asset string, weight double")
        return names.join(known, "asset", "left").select("asset", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return names.crossJoin(names.agg((F.lit(1.0) / F.count("*")).alias("weight")))  # one row


def equilibrium(cov: DataFrame, weights: DataFrame, aversion: float = config.BL_RISK_AVERSION) -> DataFrame:
    """asset, implied: aversion times the covariance with the market portfolio."""
    joined = cov.join(weights.withColumnRenamed("asset", "asset_j"), "asset_j")
    return joined.groupBy(F.col("asset_i").alias("asset")).agg((aversion * F.sum(F.col("cov") * F.col("weight"))).alias("implied"))


@dataclass(frozen=True)
class View:
    """coefficients of assets, the return they have together, and a confidence in (0, 1]. Views don't change; a
    posterior is computed anew from those it is given."""

    coefficients: tuple[tuple[str, float], ...]
    q: float
    confidence: float

    @classmethod
    def absolute(cls, asset: str, value: float, confidence: float) -> View:
        return cls(((asset, 1.0),), value, confidence)

    @classmethod
    def relative(cls, better: str, worse: str, difference: float, confidence: float) -> View:
        return cls(((better, 1.0), (worse, -1.0)), difference, confidence)


def prepared(views: list[View], names: list[str], sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P, Q and the diagonal of Omega; views of unknown assets are left out."""
    rows, q, omega = [], [], []
    for view in views:
        if all(k in names for k, _ in view.coefficients):
            p = np.zeros(len(names))
            for k, c in view.coefficients:
                p[names.index(k)] = c
            doubt = max((1 / view.confidence - 1) * 0.1 * (p @ sigma @ p), 1e-8) if view.confidence > 0 else 1e3
            rows.append(p)
            q.append(view.q)
            omega.append(doubt)
    return np.array(rows).reshape(-1, len(names)), np.array(q), np.array(omega)


def posterior_arrays(pi: np.ndarray, sigma: np.ndarray, p: np.ndarray, q: np.ndarray, omega: np.ndarray, tau: float = config.BL_TAU) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (of the mean); without views the equilibrium and sigma."""
    if not len(q):
        return pi, sigma
    prior = np.linalg.inv(tau * sigma)
    spread = np.linalg.inv(prior + p.T @ (p / omega[:, None]))
    return spread @ (prior @ pi + p.T @ (q / omega)), spread


def posterior(mu: DataFrame, cov: DataFrame, views: list[View], aversion: float = config.BL_RISK_AVERSION, tau: float = config.BL_TAU) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, equilibrium, posterior mean and covariance."""
    implied = equilibrium(cov, market_weights(mu), aversion).withColumnRenamed("implied", "mu")
    names, pi, sigma = arrays(implied, cov)
    mean, spread = posterior_arrays(pi, sigma, *prepared(views, names, sigma), tau)
    return names, pi, mean, spread


def compared(mu: DataFrame, cov: DataFrame, views: list[View]) -> DataFrame:
    """asset, prior, posterior, difference and its per cent."""
    names, pi, mean, _ = posterior(mu, cov, views)
    frame = mu.sparkSession.createDataFrame([(k, float(a), float(b)) for k, a, b in zip(names, pi, mean, strict=True)], "asset string, prior double, posterior double")
    difference = F.col("posterior") - F.col("prior")
    return frame.select("*", difference.alias("difference"), (F.try_divide(difference, F.abs("prior")) * 100).alias("difference_pct"))


def moves(comparison: DataFrame, n: int = 5) -> DataFrame:
    """direction (increase or decrease), place and a row of compared(): the n assets of the largest and of the least
    difference; of equal ones the first by name."""
    found = [
        comparison.select(F.lit(kind).alias("direction"), F.row_number().over(W.orderBy(order, "asset")).alias("place"), *comparison.columns).filter(F.col("place") <= n)
        for kind, order in (("increase", F.desc("difference")), ("decrease", F.asc("difference")))  # a row an asset
    ]
    return found[0].unionByName(found[1])


def column_correlation(matrix: np.ndarray) -> np.ndarray:
    """The correlation of a matrix's columns; not a number for a column that doesn't vary."""
    apart = matrix - matrix.mean(axis=0)
    size = np.sqrt((apart * apart).sum(axis=0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return apart.T @ apart / np.outer(size, size)


def covariance_change(mu: DataFrame, cov: DataFrame, views: list[View]) -> DataFrame:
    """asset_i, asset_j, the covariance before and after the views (of the mean, after), and the correlation of the
    matrices' columns before, after and its change."""
    names, _, sigma = arrays(equilibrium(cov, market_weights(mu)).withColumnRenamed("implied", "mu"), cov)
    spread = posterior(mu, cov, views)[3]
    before, after = column_correlation(sigma), column_correlation(spread)
    rows = [(a, b, *(float(x[i, j]) for x in (sigma, spread, before, after, after - before))) for i, a in enumerate(names) for j, b in enumerate(names)]
    return mu.sparkSession.createDataFrame(rows, "asset_i string, asset_j string, prior double, posterior double, prior_correlation double, posterior_correlation double, correlation_change double")


def optimise(mu: DataFrame, cov: DataFrame, views: list[View], objective: str = "sharpe", aversion: float = 1.0, rf: float = config.RISK_FREE_RATE, low: float = config.MIN_WEIGHT, high: float = config.MAX_WEIGHT) -> DataFrame:
    """Weights by posterior moments within the box; no rows if the box holds no portfolio."""
    names, _, mean, spread = posterior(mu, cov, views)
    spread = (spread + spread.T) / 2
    if objective == "sharpe":
        w = solvers.max_sharpe(mean, spread, rf, low, high)
    elif objective == "min_variance":
        w = solvers.min_variance(spread, low, high)
    elif objective == "utility":
        w = solvers.utility(mean, spread, aversion, low, high)
    else:
        raise ValueError(f"no objective {objective}")
    return weights_frame(mu.sparkSession, f"bl_{objective}", names, w)
