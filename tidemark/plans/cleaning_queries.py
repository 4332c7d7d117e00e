"""Cleaning: fills, calendars, interpolation, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..sources import panels as P
from .registry import CELLS, DAILY, FILLED, MACRO, WEEKLY, WEEKLY_RETURNS, query, r, returns_of

MONTH_SCAFFOLD = """span AS (SELECT min(date) AS a, max(date) AS b FROM macro),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)"""


@query(f"WITH {DAILY}, {CELLS} SELECT asset, count(*) AS n_dates, CAST(count(*) FILTER (price IS NULL) AS BIGINT) AS n_missing, {r('avg(CASE WHEN price IS NULL THEN 100.0 ELSE 0.0 END)', 'missing_pct')} FROM cells GROUP BY asset")
def clean_missing_pct(spark: SparkSession, d: str) -> DataFrame:
    return C.missing(C.scaffold(P.daily_prices(spark, d)))


@query(
    f"WITH {DAILY}, {CELLS}, good AS (SELECT asset FROM cells GROUP BY asset HAVING avg(CASE WHEN price IS NULL THEN 100.0 ELSE 0.0 END) < 15) "
    f"SELECT date, asset, {r('price', 'price')} FROM cells SEMI JOIN good USING (asset)"
)
def clean_coverage_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.keep_covered(C.scaffold(P.daily_prices(spark, d)))


@query(f"WITH {DAILY}, {CELLS}, {FILLED} SELECT date, asset, {r('price', 'price')} FROM filled")
def clean_fill(spark: SparkSession, d: str) -> DataFrame:
    return C.fill(C.scaffold(P.daily_prices(spark, d)))


@query(f"WITH {DAILY}, {CELLS} SELECT date, asset, {r('price', 'price')} FROM cells WHERE date IN (SELECT date FROM cells GROUP BY date HAVING count(price) = count(*))")
def clean_complete_dates(spark: SparkSession, d: str) -> DataFrame:
    return C.complete_dates(C.scaffold(P.daily_prices(spark, d)))


@query(f"WITH {WEEKLY_RETURNS} SELECT date, asset, {r('price', 'price')}, {r('ret', 'ret')} FROM r JOIN panel USING (date, asset)")
def clean_returns(spark: SparkSession, d: str) -> DataFrame:
    return C.simple_returns(P.weekly_prices(spark, d))


@query(
    f"WITH {WEEKLY_RETURNS} SELECT date, asset, {r('ret', 'ret')}, "
    f"{r('CASE WHEN count(ret) OVER w >= 5 THEN (ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) END', 'z')} "
    "FROM r WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
)
def clean_rolling_z(spark: SparkSession, d: str) -> DataFrame:
    return C.rolling_z(C.simple_returns(P.weekly_prices(spark, d))).select("date", "asset", "ret", "z")


WINSOR = f"""WITH {WEEKLY_RETURNS},
z AS (SELECT CASE WHEN count(ret) OVER w >= 5 THEN (ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) END AS z FROM r
      WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fires AS (SELECT coalesce(max(abs(z)) > 2.0, false) AS f FROM z),
q AS (SELECT asset, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM r GROUP BY asset),
x AS (SELECT date, asset, CASE WHEN f THEN greatest(least(ret, hi), lo) ELSE ret END AS ret FROM r JOIN q USING (asset) CROSS JOIN fires)"""


@query(f"{WINSOR} SELECT date, asset, {r('ret', 'ret')} FROM x")
def clean_winsorize(spark: SparkSession, d: str) -> DataFrame:
    """With a threshold of two deviations, so that the rule fires on these data."""
    return C.winsorized(C.simple_returns(P.weekly_prices(spark, d)), threshold=2.0).select("date", "asset", "ret")


@query(
    f"""{WINSOR}, f0 AS (SELECT asset, min(date) AS d0, arg_min(price, date) AS p0 FROM panel GROUP BY asset)
SELECT date, asset, {r('p0 * product(1 + ret) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'price', 4)} FROM x JOIN f0 USING (asset)
UNION ALL SELECT d0, asset, {r('p0', 'price', 4)} FROM f0""",
    digits=4,
)
def clean_rebuild(spark: SparkSession, d: str) -> DataFrame:
    prices = P.weekly_prices(spark, d)
    returns = C.winsorized(C.simple_returns(prices), threshold=2.0)
    return C.rebuilt(prices, returns)


BUSINESS = """days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM panel), (SELECT max(date) FROM panel), INTERVAL 1 DAY)) AS DATE) AS date),
grid AS (SELECT date, asset FROM days CROSS JOIN (SELECT DISTINCT asset FROM panel) WHERE isodow(date) < 6)"""


@query(
    f"WITH {DAILY}, {BUSINESS} SELECT date, asset, {r('last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'price')} "
    "FROM grid LEFT JOIN panel USING (date, asset)"
)
def clean_business_days(spark: SparkSession, d: str) -> DataFrame:
    return C.business_days(P.daily_prices(spark, d))


@query(
    f"WITH {DAILY}, m AS (SELECT asset, last_day(date) AS date, arg_max(price, date) AS price FROM panel GROUP BY 1, 2), {returns_of('m')} "
    f"SELECT date, asset, {r('price', 'price')}, {r('ret', 'ret')} FROM r JOIN m USING (date, asset)"
)
def clean_monthly_returns(spark: SparkSession, d: str) -> DataFrame:
    return C.simple_returns(C.month_ends(P.daily_prices(spark, d))).select("date", "asset", "price", "ret")


def _interpolate_sql(grid: str, x: str) -> str:
    return f"""x AS (SELECT *, {x} AS x FROM {grid}),
k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN x END IGNORE NULLS) OVER b AS xa, last_value(value IGNORE NULLS) OVER b AS va,
        first_value(CASE WHEN value IS NOT NULL THEN x END IGNORE NULLS) OVER f AS xb, first_value(value IGNORE NULLS) OVER f AS vb
      FROM x WINDOW b AS (PARTITION BY factor ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    f AS (PARTITION BY factor ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT date, factor, {r('coalesce(value, va + (vb - va) / nullif(xb - xa, 0) * (x - xa), va, vb)', 'value')} FROM k"""


HOLED = "holed AS (SELECT date, factor, CASE WHEN month(date) IN (1, 4, 5, 6, 11) THEN NULL ELSE value END AS value FROM macro)"


def _holed(spark: SparkSession, d: str) -> DataFrame:
    """The macro panel with five months of each year left out."""
    macro = P.monthly_macro(spark, d)
    return macro.withColumn("value", F.when(F.month("date").isin(1, 4, 5, 6, 11), None).otherwise(F.col("value")))


@query(f"WITH {MACRO}, {HOLED}, {_interpolate_sql('holed', "date_diff('day', DATE '1970-01-01', date)")}")
def clean_interpolate_time(spark: SparkSession, d: str) -> DataFrame:
    return C.interpolated(_holed(spark, d))


@query(f"WITH {MACRO}, {HOLED}, {_interpolate_sql('holed', 'row_number() OVER (PARTITION BY factor ORDER BY date)')}")
def clean_interpolate_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.interpolated(_holed(spark, d), by_time=False)


@query(
    f"WITH {MACRO}, {MONTH_SCAFFOLD}, grid AS (SELECT d.date, f.factor, m.value FROM days d CROSS JOIN (SELECT DISTINCT factor FROM macro) f LEFT JOIN macro m ON m.date = d.date AND m.factor = f.factor WHERE isodow(d.date) < 6), "
    + _interpolate_sql("grid", "date_diff('day', DATE '1970-01-01', date)")
)
def clean_upsample(spark: SparkSession, d: str) -> DataFrame:
    return C.to_business_days(P.monthly_macro(spark, d))


@query(
    f"WITH {MACRO}, u AS (SELECT date, factor, value, 0 AS s FROM macro WHERE factor < '4' UNION ALL SELECT date, factor, -value, 1 FROM macro WHERE factor >= '2') "
    f"SELECT date, factor, {r('value', 'value')} FROM u QUALIFY row_number() OVER (PARTITION BY date, factor ORDER BY s) = 1"
)
def clean_concat_first(spark: SparkSession, d: str) -> DataFrame:
    macro = P.monthly_macro(spark, d)
    return C.concat_first(macro.filter("factor < '4'"), macro.filter("factor >= '2'").withColumn("value", -F.col("value"))).select("date", "factor", "value")


LEVELS = ("1-URGENT", "2-HIGH")


@query(
    f"""WITH {MACRO}, c AS (SELECT date, factor, CASE WHEN factor IN {LEVELS} THEN value - lag(value) OVER w ELSE (value / nullif(lag(value) OVER w, 0) - 1) * 100 END AS change
  FROM macro WINDOW w AS (PARTITION BY factor ORDER BY date))
SELECT date, factor || CASE WHEN factor IN {LEVELS} THEN '_change' ELSE '_pct_change' END AS factor, {r('change', 'change')} FROM c
WHERE date IN (SELECT date FROM c GROUP BY date HAVING count(change) = count(*))"""
)
def clean_macro_changes(spark: SparkSession, d: str) -> DataFrame:
    return C.macro_changes(P.monthly_macro(spark, d), LEVELS)


@query(f"WITH {WEEKLY} SELECT date, asset, {r('price', 'price')} FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def clean_date_range(spark: SparkSession, d: str) -> DataFrame:
    return P.weekly_prices(spark, d).filter(F.col("date").between("1996-01-01", "1996-12-31"))


@query(
    f"""WITH {DAILY}, {CELLS}, {FILLED}, {returns_of('filled')},
z AS (SELECT CASE WHEN count(ret) OVER w >= 5 THEN (ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0) END AS z FROM r
      WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fires AS (SELECT coalesce(max(abs(z)) > 4.0, false) AS f FROM z),
q AS (SELECT asset, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM r GROUP BY asset),
x AS (SELECT date, asset, CASE WHEN f THEN greatest(least(ret, hi), lo) ELSE ret END AS ret FROM r JOIN q USING (asset) CROSS JOIN fires),
f0 AS (SELECT asset, min(date) AS d0, arg_min(price, date) AS p0 FROM filled GROUP BY asset),
b AS (SELECT date, asset, p0 * product(1 + ret) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM x JOIN f0 USING (asset)
      UNION ALL SELECT d0, asset, p0 FROM f0),
days AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM b), (SELECT max(date) FROM b), INTERVAL 1 DAY)) AS DATE) AS date),
g AS (SELECT date, asset FROM days CROSS JOIN (SELECT DISTINCT asset FROM b) WHERE isodow(date) < 6)
SELECT date, asset, {r('last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'price', 3)}
FROM g LEFT JOIN b USING (date, asset)""",
    digits=3,
)
def clean_prices_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_prices(P.daily_prices(spark, d))
