"""Validation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import validation as V
from ..sources import panels as P
from .registry import CELLS, DAILY, MACRO, WEEKLY_RETURNS, query, r, returns_of

MARKET = "STANDARD"
PAIRS = """pairs AS (SELECT a.asset AS asset_i, b.asset AS asset_j, corr(a.ret, b.ret) AS correlation, covar_samp(a.ret, b.ret) AS cov FROM r a JOIN r b USING (date) GROUP BY 1, 2)"""
VOLS = f"""v AS (SELECT date, asset, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) END AS vol FROM r
  WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), vols AS (SELECT * FROM v WHERE vol IS NOT NULL)"""
MONTHLY = f"{DAILY}, m AS (SELECT asset, date_trunc('month', date)::DATE AS date, arg_max(price, date) AS price FROM panel GROUP BY 1, 2), {returns_of('m')}"


def weekly_returns(spark: SparkSession, d: str) -> DataFrame:
    return C.simple_returns(P.weekly_prices(spark, d)).select("date", "asset", "ret")


def monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    monthly = C.month_ends(P.daily_prices(spark, d)).withColumn("date", F.trunc("date", "MM"))
    return C.simple_returns(monthly).select("date", "asset", "ret")


@query(
    f"WITH {DAILY}, {CELLS} SELECT count(DISTINCT asset) AS n_assets, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_dates, CAST(count(*) FILTER (price IS NULL) AS BIGINT) AS n_null, "
    f"{r('avg(CASE WHEN price IS NULL THEN 100.0 ELSE 0.0 END)', 'null_pct')} FROM cells"
)
def validate_profile(spark: SparkSession, d: str) -> DataFrame:
    return V.profile(C.scaffold(P.daily_prices(spark, d)))


@query(
    f"WITH {WEEKLY_RETURNS} SELECT asset, {r('avg(ret)', 'mean')}, {r('stddev_samp(ret)', 'std')}, {r('min(ret)', 'min')}, {r('max(ret)', 'max')}, {r('skewness(ret)', 'skew')}, {r('kurtosis(ret)', 'kurtosis')} FROM r GROUP BY asset"
)
def validate_return_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.return_stats(weekly_returns(spark, d))


@query(
    f"""WITH {WEEKLY_RETURNS}, c AS (SELECT asset, ret - avg(ret) OVER (PARTITION BY asset) AS x FROM r),
m AS (SELECT asset, count(*) AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c GROUP BY asset),
j AS (SELECT asset, n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m)
SELECT asset, {r('jb', 'jb')}, {r('exp(-jb / 2)', 'p_value')}, exp(-jb / 2) > 0.05 AS normal FROM j"""
)
def validate_jarque_bera(spark: SparkSession, d: str) -> DataFrame:
    return V.jarque_bera(weekly_returns(spark, d))


#: One sweep a variable leaves the products of the rest: the squared error of every number of lags, then the level's t-value.
ADF_SQL = f"""WITH RECURSIVE {WEEKLY_RETURNS}, s0 AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, ret - avg(ret) OVER (PARTITION BY asset) AS x, count(*) OVER (PARTITION BY asset) AS n FROM r),
s1 AS (SELECT *, lead(x) OVER (PARTITION BY asset ORDER BY i) - x AS d, least(CAST(ceil(12 * pow(n / 100.0, 0.25)) AS INTEGER), n // 2 - 2) AS most FROM s0),
rows_ AS (SELECT asset, i, n, most, x, d FROM s1 WHERE d IS NOT NULL),
lagged AS (SELECT a.asset, a.i, l.k AS lag, b.d AS v FROM rows_ a CROSS JOIN (SELECT unnest(range(1, 60)) AS k) l JOIN rows_ b ON b.asset = a.asset AND b.i = a.i - l.k WHERE l.k <= a.most),
v1 AS (SELECT asset, i, 0 AS k, 1.0::DOUBLE AS v FROM rows_ WHERE i >= most UNION ALL SELECT asset, i, 1, x FROM rows_ WHERE i >= most UNION ALL SELECT asset, i, 1000, d FROM rows_ WHERE i >= most
  UNION ALL SELECT asset, i, lag + 1, v FROM lagged JOIN (SELECT DISTINCT asset, most FROM rows_) USING (asset) WHERE i >= most),
m1 AS (SELECT a.asset, a.k AS p, b.k AS q, sum(a.v * b.v) AS v FROM v1 a JOIN v1 b USING (asset, i) GROUP BY ALL),
w1 AS (SELECT asset, 0 AS step, p, q, v FROM m1 UNION ALL
  SELECT a.asset, a.step + 1, a.p, a.q, a.v - b.v * c.v / e.v FROM w1 a JOIN w1 b ON b.asset = a.asset AND b.p = a.p AND b.q = a.step JOIN w1 c ON c.asset = a.asset AND c.p = a.step AND c.q = a.q JOIN w1 e ON e.asset = a.asset AND e.p = a.step AND e.q = a.step
  WHERE a.p > a.step AND a.q > a.step),
fit AS (SELECT asset, step - 2 AS lags, v AS ssr FROM w1 WHERE p = 1000 AND q = 1000 AND step >= 2),
size1 AS (SELECT asset, count(*) AS rows FROM rows_ WHERE i >= most GROUP BY 1),
best AS (SELECT asset, CAST(arg_min(lags, rows * (ln(2 * pi()) + ln(ssr / rows) + 1) + 2 * (lags + 2)) AS INTEGER) AS lags FROM fit JOIN size1 USING (asset) GROUP BY 1),
v2 AS (SELECT asset, i, 0 AS k, 1.0::DOUBLE AS v FROM rows_ JOIN best USING (asset) WHERE i >= lags UNION ALL SELECT asset, i, 500, x FROM rows_ JOIN best USING (asset) WHERE i >= lags UNION ALL SELECT asset, i, 1000, d FROM rows_ JOIN best USING (asset) WHERE i >= lags
  UNION ALL SELECT asset, i, lag, v FROM lagged JOIN best USING (asset) WHERE i >= lags AND lag <= lags),
m2 AS (SELECT a.asset, a.k AS p, b.k AS q, sum(a.v * b.v) AS v FROM v2 a JOIN v2 b USING (asset, i) GROUP BY ALL),
w2 AS (SELECT asset, 0 AS step, p, q, v FROM m2 UNION ALL
  SELECT a.asset, a.step + 1, a.p, a.q, a.v - b.v * c.v / e.v FROM w2 a JOIN w2 b ON b.asset = a.asset AND b.p = a.p AND b.q = a.step JOIN w2 c ON c.asset = a.asset AND c.p = a.step AND c.q = a.q JOIN w2 e ON e.asset = a.asset AND e.p = a.step AND e.q = a.step
  WHERE a.p > a.step AND a.q > a.step),
left_ AS (SELECT asset, lags, max(v) FILTER (p = 500 AND q = 500) AS ll, max(v) FILTER (p = 500 AND q = 1000) AS ly, max(v) FILTER (p = 1000 AND q = 1000) AS yy FROM w2 JOIN best USING (asset) WHERE step = lags + 1 GROUP BY 1, 2),
size2 AS (SELECT asset, count(*) AS rows FROM rows_ JOIN best USING (asset) WHERE i >= lags GROUP BY 1),
tested AS (SELECT asset, ly / ll / sqrt((yy - ly * ly / ll) / (rows - lags - 2) / ll) AS t FROM left_ JOIN size2 USING (asset)),
surface AS (SELECT asset, t, CASE WHEN t <= -1.61 THEN 2.1659 + 1.4412 * t + 0.038269 * t * t ELSE 1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t * t * t END AS z FROM tested),
judged AS (SELECT asset, t, CASE WHEN t > 2.74 THEN 1.0 WHEN t < -18.83 OR z < -12 THEN 0.0 ELSE list_sum(list_transform(range(4000), lambda k: exp(-pow(-12 + (k + 0.5) * (z + 12) / 4000, 2) / 2))) * (z + 12) / 4000 / sqrt(2 * pi()) END AS p FROM surface)
SELECT asset, {r('t', 'adf_stat')}, {r('p', 'p_value')}, p < 0.05 AS stationary FROM judged"""


@query(ADF_SQL)
def validate_adf(spark: SparkSession, d: str) -> DataFrame:
    return V.adf(weekly_returns(spark, d))


@query(f"WITH {WEEKLY_RETURNS}, {PAIRS} SELECT asset_i, asset_j, {r('correlation', 'correlation', 9)}, {r('cov', 'cov', 9)} FROM pairs", digits=9)
def validate_correlation_tiled(spark: SparkSession, d: str) -> DataFrame:
    """The way that many assets take, with blocks of two."""
    return V.pair_stats(weekly_returns(spark, d), few=0, block=2)


@query(f"WITH {WEEKLY_RETURNS}, {PAIRS} SELECT asset_i, asset_j, {r('correlation', 'correlation', 9)}, {r('cov', 'cov', 9)} FROM pairs", digits=9)
def validate_correlation(spark: SparkSession, d: str) -> DataFrame:
    return V.pair_stats(weekly_returns(spark, d))


@query(
    f"WITH {WEEKLY_RETURNS}, {PAIRS} SELECT asset_i, asset_j, {r('correlation', 'correlation')}, 'duplicate' AS flag FROM pairs WHERE asset_i < asset_j AND abs(correlation) > 0.05 "
    f"UNION ALL SELECT asset_i, asset_j, {r('correlation', 'correlation')}, 'extreme_negative' FROM pairs WHERE asset_i < asset_j AND correlation < -0.05"
)
def validate_correlation_flags(spark: SparkSession, d: str) -> DataFrame:
    """With low bounds, so that both flags are met on these data."""
    return V.correlation_flags(V.pair_stats(weekly_returns(spark, d)), same=0.05, opposite=-0.05)


@query(f"WITH {WEEKLY_RETURNS}, {VOLS} SELECT asset, {r('min(vol)', 'min_vol')}, {r('max(vol)', 'max_vol')}, {r('avg(vol)', 'avg_vol')} FROM vols GROUP BY asset")
def validate_rolling_vol(spark: SparkSession, d: str) -> DataFrame:
    return V.rolling_vol_stats(weekly_returns(spark, d))


@query(f"WITH {WEEKLY_RETURNS}, {VOLS} SELECT date, asset, {r('vol', 'vol')} FROM vols QUALIFY vol > 1.3 * avg(vol) OVER (PARTITION BY asset)")
def validate_extreme_vol(spark: SparkSession, d: str) -> DataFrame:
    return V.extreme_vol(weekly_returns(spark, d), times=1.3)


@query(
    f"""WITH {WEEKLY_RETURNS}, {PAIRS}, {VOLS}, c AS (SELECT asset, ret - avg(ret) OVER (PARTITION BY asset) AS x FROM r),
m AS (SELECT asset, count(*) AS n, avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c GROUP BY asset),
j AS (SELECT n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m)
SELECT (SELECT count(*) FILTER (price IS NULL) = 0 FROM panel) AS passed, (SELECT count(DISTINCT asset) FROM panel) AS n_assets,
  (SELECT CAST(count(*) FILTER (exp(-jb / 2) <= 0.05) AS BIGINT) FROM j) AS n_not_normal,
  (SELECT CAST(count(*) FILTER (abs(correlation) > 0.99) + count(*) FILTER (correlation < -0.9) AS BIGINT) FROM pairs WHERE asset_i < asset_j) AS n_correlation_flags,
  (SELECT count(*) FROM (SELECT 1 FROM vols QUALIFY vol > 3 * avg(vol) OVER (PARTITION BY asset))) AS n_extreme_rows"""
)
def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    prices = P.weekly_prices(spark, d)
    return V.validation_summary(prices, weekly_returns(spark, d))


@query(
    f"WITH {MACRO} SELECT factor, {r('avg(value)', 'mean', 4)}, {r('stddev_samp(value)', 'std', 4)}, {r('min(value)', 'min', 4)}, {r('max(value)', 'max', 4)}, {r('arg_min(value, date)', 'first', 4)}, {r('arg_max(value, date)', 'last', 4)}, "
    f"{r('arg_max(value, date) - arg_min(value, date)', 'change', 4)} FROM macro GROUP BY factor",
    digits=4,
)
def validate_macro_stats(spark: SparkSession, d: str) -> DataFrame:
    return V.macro_stats(P.monthly_macro(spark, d))


ACF = f"""{MACRO}, c AS (SELECT factor, date, value - avg(value) OVER (PARTITION BY factor) AS x FROM macro),
s AS (SELECT factor, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM c WINDOW w AS (PARTITION BY factor ORDER BY date)),
t AS (SELECT factor, sum(x * x) AS ss, sum(x * l1) AS s1, sum(x * l2) AS s2, sum(x * l3) AS s3 FROM s GROUP BY factor),
acf AS (SELECT factor, 1 AS lag, s1 / ss AS acf FROM t UNION ALL SELECT factor, 2, s2 / ss FROM t UNION ALL SELECT factor, 3, s3 / ss FROM t)"""


@query(f"WITH {ACF} SELECT factor, lag, {r('acf', 'acf')} FROM acf")
def validate_autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return V.autocorrelation(P.monthly_macro(spark, d))


MARKET_JOIN = f"{MONTHLY}, {MACRO}, fm AS (SELECT factor, corr(value, ret) AS correlation FROM macro JOIN r USING (date) WHERE asset = 'NO' GROUP BY factor)"


@query(f"WITH {MARKET_JOIN} SELECT factor, {r('correlation', 'correlation')} FROM fm")
def validate_factor_market(spark: SparkSession, d: str) -> DataFrame:
    return V.factor_market(P.monthly_macro(spark, d), monthly_returns(spark, d), "NO")


@query(f"WITH {ACF}, {MONTHLY}, fm AS (SELECT factor, corr(value, ret) AS correlation FROM macro JOIN r USING (date) WHERE asset = 'NO' GROUP BY factor) SELECT (SELECT count(*) FROM acf WHERE lag = 1 AND abs(acf) > 0.7) AS n_persistent, (SELECT count(*) FROM fm WHERE abs(correlation) > 0.3) AS n_market")
def validate_macro_summary(spark: SparkSession, d: str) -> DataFrame:
    macro = P.monthly_macro(spark, d)
    lasting = V.autocorrelation(macro, lags=(1,)).agg(F.count_if(F.abs("acf") > 0.7).alias("n_persistent"))
    return lasting.crossJoin(V.factor_market(macro, monthly_returns(spark, d), "NO").agg(F.count_if(F.abs("correlation") > 0.3).alias("n_market")))  # a row each


@query(f"WITH {DAILY} SELECT asset, count(price) AS n, {r('avg(price)', 'mean')}, {r('stddev_samp(price)', 'std')}, {r('min(price)', 'min')}, {r('quantile_cont(price, 0.25)', 'q25')}, {r('quantile_cont(price, 0.5)', 'q50')}, {r('quantile_cont(price, 0.75)', 'q75')}, {r('max(price)', 'max')} FROM panel GROUP BY asset")
def validate_describe(spark: SparkSession, d: str) -> DataFrame:
    return V.describe(P.daily_prices(spark, d))


@query(f"WITH {MONTHLY}, {MACRO} SELECT asset, factor, {r('corr(ret, value)', 'correlation')} FROM r JOIN macro USING (date) GROUP BY asset, factor")
def validate_asset_macro(spark: SparkSession, d: str) -> DataFrame:
    return V.asset_macro(monthly_returns(spark, d), P.monthly_macro(spark, d))


@query(
    f"""WITH {WEEKLY_RETURNS}, s AS (SELECT asset, min(ret) AS lo, max(ret) AS hi, count(*) AS total, avg(ret) AS mean, stddev_samp(ret) AS std FROM r GROUP BY asset),
b AS (SELECT asset, CAST(least(floor((ret - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, lo, (hi - lo) / 50 AS width, total, mean, std FROM r JOIN s USING (asset)),
g AS (SELECT asset, bin, lo, width, total, mean, std, count(*) AS n FROM b GROUP BY ALL)
SELECT asset, bin, n, {r('n / (total * width)', 'density', 4)}, {r('exp(-pow((lo + (bin + 0.5) * width - mean) / std, 2) / 2) / (std * sqrt(2 * pi()))', 'normal_density', 4)} FROM g""",
    digits=4,
)
def validate_histogram(spark: SparkSession, d: str) -> DataFrame:
    return V.histogram(weekly_returns(spark, d))


def _horner(coefficients: list[float], x: str) -> str:
    out = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


def ppf_sql(p: str) -> str:
    from ..functions import stats as S

    q, low, high = f"({p} - 0.5)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    middle = f"{_horner(S.PPF_A, f'({q} * {q})')} * {q} / {_horner(S.PPF_B, f'({q} * {q})')}"
    tail = lambda t: f"{_horner(S.PPF_C, t)} / {_horner(S.PPF_D, t)}"
    return f"CASE WHEN {p} < {S.PPF_TAIL} THEN {tail(low)} WHEN {p} > {1 - S.PPF_TAIL} THEN -{tail(high)} ELSE {middle} END"


@query(
    f"""WITH {WEEKLY_RETURNS}, o AS (SELECT asset, (ret - avg(ret) OVER (PARTITION BY asset)) / stddev_samp(ret) OVER (PARTITION BY asset) AS z,
  CAST(row_number() OVER (PARTITION BY asset ORDER BY ret, date) AS INTEGER) AS place, count(*) OVER (PARTITION BY asset) AS n FROM r), p AS (SELECT *, (place - 0.5::DOUBLE) / n AS p FROM o)
SELECT asset, place, {r(ppf_sql('p'), 'theoretical')}, {r('z', 'ordered')} FROM p"""
)
def validate_quantile_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.quantile_pairs(weekly_returns(spark, d))
