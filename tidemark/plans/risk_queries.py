"""Risk by asset and for portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import risk as R
from ..sources import panels as P
from .registry import WEEKLY, WEEKLY_RETURNS, query, r

MARKET = "STANDARD"
RF = 0.035


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    prices = P.weekly_prices(spark, d)
    return C.simple_returns(prices).select("date", "asset", "ret"), prices


VOL = """rw AS (SELECT *, CASE WHEN count(ret) OVER w21 = 21 THEN stddev_samp(ret) OVER w21 * sqrt(252) END AS v21, CASE WHEN count(ret) OVER w63 = 63 THEN stddev_samp(ret) OVER w63 * sqrt(252) END AS v63,
    pow(1 - 2 / 31.0::DOUBLE, row_number() OVER (PARTITION BY asset ORDER BY date DESC) - 1) AS k
  FROM r WINDOW w21 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), w63 AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
vs AS (SELECT asset, stddev_samp(ret) AS daily_vol, arg_max(v21, date) AS recent_vol, arg_max(v63, date) AS quarterly_vol, stddev_samp(ret) FILTER (ret > 0) * sqrt(252) AS upside_vol,
    stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS downside_vol, stddev_samp(v21) / nullif(avg(v21), 0) AS vol_of_vol, sum(k) AS w1, sum(k * k) AS w2, sum(k * ret) AS wx, sum(k * ret * ret) AS wxx
  FROM rw GROUP BY asset),
vol AS (SELECT asset, daily_vol, daily_vol * sqrt(252) AS annual_vol, recent_vol, quarterly_vol, sqrt((wxx / w1 - pow(wx / w1, 2)) * w1 * w1 / (w1 * w1 - w2)) * sqrt(252) AS ewma_vol,
    upside_vol, downside_vol, downside_vol / nullif(upside_vol, 0) AS vol_ratio, vol_of_vol FROM vs)"""
VOL_COLUMNS = ["daily_vol", "annual_vol", "recent_vol", "quarterly_vol", "ewma_vol", "upside_vol", "downside_vol", "vol_ratio", "vol_of_vol"]
Z = R.Z05
TAIL = f"""tb AS (SELECT asset, -quantile_cont(ret, 0.05) AS var_95, -quantile_cont(ret, 0.01) AS var_99, avg(ret) AS mu, stddev_samp(ret) AS sigma, skewness(ret) AS s, kurtosis(ret) AS k, -min(ret) AS max_loss FROM r GROUP BY asset),
tc AS (SELECT asset, -avg(ret) FILTER (ret <= -var_95) AS cvar_95, -avg(ret) FILTER (ret <= -var_99) AS cvar_99 FROM r JOIN tb USING (asset) GROUP BY asset),
zz AS (SELECT CAST({Z!r} AS DOUBLE) AS z),
tail AS (SELECT asset, var_95, var_99, cvar_95, cvar_99, -(mu + z * sigma * (1 + s * z / 6 + (k - 3) * z * z / 24 - s * s * z * z * z / 36)) AS modified_var_95,
    -(mu + sigma * (z + s * (z * z - 1) / 6 + k * (z * z * z - 3 * z) / 24 - s * s * (2 * z * z * z - 5 * z) / 36)) AS cornish_fisher_var_95, s AS skew, k AS kurtosis, max_loss FROM tb JOIN tc USING (asset) CROSS JOIN zz)"""
TAIL_COLUMNS = ["var_95", "var_99", "cvar_95", "cvar_99", "modified_var_95", "cornish_fisher_var_95", "skew", "kurtosis", "max_loss"]
DD = """dd AS (SELECT date, asset, price, price / max(price) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM panel),
de AS (SELECT asset, date AS dd_end FROM dd QUALIFY row_number() OVER (PARTITION BY asset ORDER BY drawdown, date) = 1),
ds AS (SELECT asset, dd_end, date AS dd_start, price AS sp FROM dd JOIN de USING (asset) WHERE date <= dd_end QUALIFY row_number() OVER (PARTITION BY asset ORDER BY price DESC, date) = 1),
dr AS (SELECT asset, min(date) AS rec FROM dd JOIN ds USING (asset) WHERE date >= dd_end AND price >= sp GROUP BY asset),
da AS (SELECT asset, min(drawdown) AS max_drawdown, coalesce(avg(drawdown) FILTER (drawdown < 0), 0) AS avg_drawdown, CAST(count(*) FILTER (drawdown < 0) AS BIGINT) AS underwater_days, avg(CASE WHEN drawdown < 0 THEN 1.0 ELSE 0.0 END) AS underwater_ratio FROM dd GROUP BY asset),
draw AS (SELECT da.*, dd_start, dd_end, CAST(dd_end - dd_start AS BIGINT) AS duration_days, CAST(rec - dd_end AS BIGINT) AS recovery_days FROM da JOIN ds USING (asset) LEFT JOIN dr USING (asset))"""
DD_SELECT = f"{r('max_drawdown', 'max_drawdown')}, {r('avg_drawdown', 'avg_drawdown')}, dd_start, dd_end, duration_days, recovery_days, underwater_days, {r('underwater_ratio', 'underwater_ratio')}"
PERF = f"""pb AS (SELECT asset, product(1 + ret) - 1 AS total_return, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS std, stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS down, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive_ratio FROM r GROUP BY asset),
pa AS (SELECT a.asset, stddev_samp(a.ret - b.ret) * sqrt(252) AS te, pow(product(1 + a.ret), 252.0 / count(*)) - pow(product(1 + b.ret), 252.0 / count(*)) AS ex FROM r a JOIN r b ON a.date = b.date AND b.asset = '{MARKET}' GROUP BY 1),
pm AS (SELECT asset, min(drawdown) AS md FROM dd GROUP BY asset),
perf AS (SELECT asset, total_return, pow(1 + total_return, 252.0 / n) - 1 AS annual_return, (mean - {RF} / 252) / nullif(std, 0) * sqrt(252) AS sharpe, (pow(1 + total_return, 252.0 / n) - 1 - {RF}) / nullif(down, 0) AS sortino,
    CASE WHEN md < 0 THEN (pow(1 + total_return, 252.0 / n) - 1 - {RF}) / -md END AS calmar, CASE WHEN te > 1e-12 THEN ex / te END AS information_ratio, te AS tracking_error, positive_ratio,
    (pow(1 + total_return, 252.0 / n) - 1) / nullif(std * sqrt(252), 0) AS return_vol_ratio FROM pb LEFT JOIN pa USING (asset) JOIN pm USING (asset))"""
PERF_COLUMNS = ["total_return", "annual_return", "sharpe", "sortino", "calmar", "information_ratio", "tracking_error", "positive_ratio", "return_vol_ratio"]
listed = lambda names: ", ".join(r(n, n) for n in names)


@query(f"WITH {WEEKLY_RETURNS}, {VOL} SELECT asset, {listed(VOL_COLUMNS)} FROM vol")
def risk_volatility(spark: SparkSession, d: str) -> DataFrame:
    return R.volatility(_both(spark, d)[0])


@query(f"WITH {WEEKLY_RETURNS}, {TAIL} SELECT asset, {listed(TAIL_COLUMNS)} FROM tail")
def risk_tail(spark: SparkSession, d: str) -> DataFrame:
    return R.tail_risk(_both(spark, d)[0])


@query(f"WITH {WEEKLY}, {DD} SELECT date, asset, {r('price', 'price')}, {r('drawdown', 'drawdown')} FROM dd")
def risk_drawdown_series(spark: SparkSession, d: str) -> DataFrame:
    return R.drawdown_series(P.weekly_prices(spark, d))


@query(f"WITH {WEEKLY}, {DD} SELECT asset, {DD_SELECT} FROM draw")
def risk_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return R.drawdowns(P.weekly_prices(spark, d))


@query(f"WITH {WEEKLY_RETURNS}, {DD}, {PERF} SELECT asset, {listed(PERF_COLUMNS)} FROM perf")
def risk_performance(spark: SparkSession, d: str) -> DataFrame:
    returns, prices = _both(spark, d)
    return R.performance(returns, prices, MARKET)


@query(f"WITH {WEEKLY_RETURNS}, {VOL}, {TAIL}, {DD}, {PERF} SELECT asset, {listed(VOL_COLUMNS)}, {listed(TAIL_COLUMNS)}, {DD_SELECT}, {listed(PERF_COLUMNS)} FROM vol JOIN tail USING (asset) JOIN draw USING (asset) JOIN perf USING (asset)")
def risk_all_metrics(spark: SparkSession, d: str) -> DataFrame:
    returns, prices = _both(spark, d)
    return R.all_metrics(returns, prices, MARKET)


#: Two portfolios over the assets: equal parts, and parts by the length of the name.
PORTFOLIOS = """a AS (SELECT DISTINCT asset FROM r), pw AS (SELECT 'equal' AS portfolio, asset, 1.0 / count(*) OVER () AS weight FROM a UNION ALL SELECT 'by_name', asset, length(asset)::DOUBLE / sum(length(asset)) OVER () FROM a)"""


def portfolios(returns: DataFrame) -> DataFrame:
    names = returns.select("asset").distinct()
    equal = names.select(F.lit("equal").alias("portfolio"), "asset", F.lit(1.0).alias("weight"))
    return equal.unionByName(names.select(F.lit("by_name").alias("portfolio"), "asset", F.length("asset").cast("double").alias("weight")))


PORT = f"""{WEEKLY_RETURNS}, {PORTFOLIOS}, p AS (SELECT date, portfolio, sum(weight * ret) AS ret FROM r JOIN pw USING (asset) GROUP BY 1, 2),
l AS (SELECT *, product(1 + ret) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM p),
x AS (SELECT *, level / max(level) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM l),
b AS (SELECT portfolio, avg(ret) * 252 AS annual_return, stddev_samp(ret) * sqrt(252) AS annual_vol, min(dd) AS max_drawdown, stddev_samp(ret) FILTER (ret < 0) * sqrt(252) AS down, -quantile_cont(ret, 0.05) AS var_95 FROM x GROUP BY 1),
c AS (SELECT portfolio, -avg(ret) FILTER (ret <= -var_95) AS cvar_95 FROM p JOIN b USING (portfolio) GROUP BY 1)"""


@query(f"WITH {PORT} SELECT date, portfolio, {r('ret', 'ret')} FROM p")
def risk_portfolio_returns(spark: SparkSession, d: str) -> DataFrame:
    returns, _ = _both(spark, d)
    return R.portfolio_returns(returns, portfolios(returns))


@query(
    f"WITH {PORT} SELECT portfolio, {listed(['annual_return', 'annual_vol', 'max_drawdown', 'var_95', 'cvar_95'])}, {r(f'(annual_return - {RF}) / nullif(annual_vol, 0)', 'sharpe')}, {r(f'(annual_return - {RF}) / nullif(down, 0)', 'sortino')}, "
    f"{r(f'CASE WHEN max_drawdown < 0 THEN (annual_return - {RF}) / -max_drawdown END', 'calmar')} FROM b JOIN c USING (portfolio)"
)
def risk_portfolio_metrics(spark: SparkSession, d: str) -> DataFrame:
    returns, _ = _both(spark, d)
    return R.portfolio_metrics(returns, portfolios(returns))


@query(
    f"WITH {WEEKLY_RETURNS}, s AS (SELECT asset, avg(ret) * 252 AS annual_return, stddev_samp(ret) * sqrt(252) AS annual_vol FROM r GROUP BY 1), t AS (SELECT *, (annual_return - {RF}) / nullif(annual_vol, 0) AS sharpe FROM s) "
    f"SELECT asset, {listed(['annual_return', 'annual_vol', 'sharpe'])}, CAST(row_number() OVER (ORDER BY sharpe DESC NULLS LAST, asset) AS INTEGER) AS place FROM t"
)
def risk_simple_summary(spark: SparkSession, d: str) -> DataFrame:
    return R.simple_summary(_both(spark, d)[0])


@query(f"WITH {WEEKLY_RETURNS} SELECT asset, {r('stddev_samp(ret) * sqrt(252)', 'annual_vol')} FROM r GROUP BY asset HAVING stddev_samp(ret) * sqrt(252) > 0.9")
def risk_high_volatility(spark: SparkSession, d: str) -> DataFrame:
    return R.high_volatility(_both(spark, d)[0], above=0.9)
