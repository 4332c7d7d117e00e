"""Quantiles by brackets, the risk panel, extracts with values, and all portfolios of two assets, whose weights have closed
forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import quantiles
from ..operators import backtest as T
from ..operators import cleaning as C
from ..operators import optimize as O
from ..operators import report as D
from ..operators import risk as R
from ..operators import suites as S
from ..sources import panels as P
from .portfolio_queries import F_COLUMNS, FRONTIER, MOMENTS, TWO
from .registry import WEEKLY, query, r, returns_of
from .risk_queries import DD, RF
from .strategy_queries import BT, STATIC, static_values
from .validation_queries import weekly_returns

SHARES = {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q995": 0.995}


@query(f"SELECT l_returnflag || l_linestatus AS asset, {', '.join(r(f'quantile_cont(l_extendedprice, {s})', n) for n, s in SHARES.items())} FROM lineitem GROUP BY 1")
def quantiles_by_brackets(spark: SparkSession, d: str) -> DataFrame:
    """Of every price that was paid, by kind; the sketch is coarse, so that each quantile is bracketed."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat("l_returnflag", "l_linestatus").alias("asset"), "l_extendedprice")
    return quantiles.selected(lines, "asset", "l_extendedprice", SHARES, accuracy=500, whole=1000)


RISING = f"{WEEKLY.replace('panel AS', 'own AS', 1)}, panel AS (SELECT * FROM own UNION ALL SELECT date, 'RISING', sum(sum(price)) OVER (ORDER BY date) FROM own GROUP BY date)"


@query(
    f"""WITH {RISING}, {returns_of('panel')}, {DD}, b AS (SELECT asset, avg(ret) * 252 AS annual_return, stddev_samp(ret) * sqrt(252) AS annual_vol, coalesce(stddev_samp(ret) FILTER (ret < 0) * sqrt(252), 0) AS down, -quantile_cont(ret, 0.05) AS var_95 FROM r GROUP BY 1),
c AS (SELECT asset, -avg(ret) FILTER (ret <= -var_95) AS cvar_95 FROM r JOIN b USING (asset) GROUP BY 1)
SELECT asset, {r('annual_return', 'annual_return')}, {r('annual_vol', 'annual_vol')}, {r(f'(annual_return - {RF}) / nullif(annual_vol, 0)', 'sharpe')},
  {r(f"CASE WHEN down > 0 THEN (annual_return - {RF}) / down ELSE 'infinity'::DOUBLE END", 'sortino')}, {r('down', 'downside_vol')}, {r('var_95', 'var_95')}, {r('cvar_95', 'cvar_95')}, {r('max_drawdown', 'max_drawdown')}
FROM b JOIN c USING (asset) JOIN da USING (asset)"""
)
def risk_panel(spark: SparkSession, d: str) -> DataFrame:
    """Of all assets, and of the running sum of their prices, which never falls."""
    own = P.weekly_prices(spark, d)
    sums = own.groupBy("date").agg(F.sum("price").alias("price"))
    rising = sums.select("date", F.lit("RISING").alias("asset"), F.sum("price").over(W.orderBy("date")).alias("price"))  # a row a week
    prices = own.unionByName(rising)
    return R.panel(C.simple_returns(prices).select("date", "asset", "ret"), prices)


@query(
    f"WITH {STATIC}, {BT} SELECT strategy, {r('total_return', 'total_return')}, {r('annual_return', 'annualized_return')}, {r('annual_vol', 'volatility')}, {r('sharpe', 'sharpe_ratio')}, {r('max_drawdown', 'max_drawdown')}, {r('final_value / 100000', 'final_value')} FROM bm"
)
def report_performance(spark: SparkSession, d: str) -> DataFrame:
    return D.performance_rows(T.backtest_metrics(static_values(spark, d))).withColumn("final_value", F.col("final_value") / 100_000)


#: Means, variances and volatilities of the first and last asset (x, y), and x's weight at the least variance.
ENDS = f"""{TWO}, e AS (SELECT x, y, (SELECT mu FROM mu WHERE asset = x) AS ux, (SELECT mu FROM mu WHERE asset = y) AS uy, (SELECT cov FROM s WHERE asset_i = x AND asset_j = x) AS xx,
  (SELECT cov FROM s WHERE asset_i = y AND asset_j = y) AS yy, (SELECT cov FROM s WHERE asset_i = x AND asset_j = y) AS xy FROM a),
safest AS (SELECT *, least(greatest((yy - xy) / (xx + yy - 2 * xy), 0), 1) AS ws FROM e),
ends AS (SELECT *, ws * ux + (1 - ws) * uy AS safe, greatest(ux, uy) AS most FROM safest)"""


def _lines(kind: str, top: str, points: int) -> str:
    return f"SELECT '{kind}' AS kind, k.range AS point, (safe + k.range * ({top} * most - safe) / {points - 1} - uy) / (ux - uy) AS w, ends.* FROM range({points}) k CROSS JOIN ends"


def _ends(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    names = returns.agg(F.min("asset").alias("x"), F.max("asset").alias("y"))
    return returns.crossJoin(F.broadcast(names)).filter("asset IN (x, y)").drop("x", "y")  # one row


CURVE = f"curve AS ({_lines('curve', '0.9', 20)}), held AS (SELECT *, w * ux + (1 - w) * uy AS mean, sqrt(w * w * xx + (1 - w) * (1 - w) * yy + 2 * w * (1 - w) * xy) AS risk FROM curve WHERE w BETWEEN -1e-9 AND 1 + 1e-9)"


@query(
    f"WITH {MOMENTS}, {ENDS}, {CURVE} "
    + " UNION ALL ".join(f"SELECT CAST(point AS INTEGER) AS point, {a} AS asset, {r(w, 'weight')}, {r('mean', 'expected_return')}, {r('risk', 'volatility')} FROM held" for a, w in (("x", "w"), ("y", "1 - w")))
)
def portfolio_frontier_curve_pair(spark: SparkSession, d: str) -> DataFrame:
    """Of the first and last asset: a mean has one pair of weights."""
    return O.frontier_curve(_ends(spark, d))


@query(
    f"""WITH {MOMENTS}, {ENDS}, ratio AS (SELECT *, yy * (ux - {RF}) - xy * (uy - {RF}) AS px, xx * (uy - {RF}) - xy * (ux - {RF}) AS py FROM ends),
found AS (SELECT 'max_sharpe' AS portfolio, x, y, CASE WHEN px >= 0 AND py >= 0 THEN px / (px + py) WHEN (ux - {RF}) / sqrt(xx) >= (uy - {RF}) / sqrt(yy) THEN 1 ELSE 0 END AS w FROM ratio
  UNION ALL SELECT 'min_volatility', x, y, ws FROM ends UNION ALL SELECT 'risk_parity', x, y, sqrt(yy) / (sqrt(xx) + sqrt(yy)) FROM ends
  UNION ALL SELECT kind || '_' || point, x, y, w FROM ({_lines('target', '1', 10)} UNION ALL {_lines('curve', '0.9', 30)}) WHERE w BETWEEN -1e-9 AND 1 + 1e-9)
SELECT portfolio, x AS asset, {r('w', 'weight')} FROM found UNION ALL SELECT portfolio, y, {r('1 - w', 'weight')} FROM found"""
)
def suite_optimizations_pair(spark: SparkSession, d: str) -> DataFrame:
    """Every weight of the whole run, of the first and last asset."""
    return S.optimizations(_ends(spark, d))[0]


@query(f"WITH {FRONTIER} SELECT portfolio, {F_COLUMNS} FROM f".replace("range(100) p", "range(5000) p"))
def suite_random_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The random portfolios of the whole run, all 5000."""
    return S.optimizations(weekly_returns(spark, d))[1]


@query(
    f"""WITH {FRONTIER}, {ENDS}, {CURVE}, drawn AS (SELECT * FROM f ORDER BY md5('sample-' || portfolio), portfolio LIMIT 40)
SELECT 'random' AS kind, portfolio, {F_COLUMNS}, NULL::INTEGER AS point FROM drawn
UNION ALL SELECT 'curve', NULL, {r('mean', 'expected_return')}, {r('risk', 'volatility')}, NULL, CAST(point AS INTEGER) FROM held"""
)
def report_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Forty of the random portfolios beside the curve of the first and last asset, with all values."""
    return D.frontier_points(O.random_frontier(weekly_returns(spark, d)), O.frontier_curve(_ends(spark, d)), 40)
