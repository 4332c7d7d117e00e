"""Backtests, simulations, stress tests and report extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as T
from ..operators import cleaning as C
from ..operators import optimize as O
from ..operators import report as D
from ..operators import risk as R
from ..operators import simulate as M
from ..operators import validation as V
from ..sources import panels as P
from ..sources.files import staged
from .portfolio_queries import UNIFORM
from .registry import MACRO, WEEKLY, WEEKLY_RETURNS, query, r
from .risk_queries import DD, PERF, PORT, VOL, portfolios
from .validation_queries import PAIRS, weekly_returns

#: Business days of the weekly panel, filled forwards: what backtests run on.
DAYS = f"""{WEEKLY}, dd0 AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM panel), (SELECT max(date) FROM panel), INTERVAL 1 DAY)) AS DATE) AS date),
px AS (SELECT date, asset, last_value(price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price
  FROM (SELECT date, asset FROM dd0 CROSS JOIN (SELECT DISTINCT asset FROM panel) WHERE isodow(date) < 6) LEFT JOIN panel USING (date, asset))"""
STRATEGIES = """an AS (SELECT DISTINCT asset FROM panel), sw AS (SELECT 'equal' AS strategy, asset, 1.0 / count(*) OVER () AS weight FROM an UNION ALL SELECT 'by_name', asset, length(asset)::DOUBLE / sum(length(asset)) OVER () FROM an
  UNION ALL SELECT 'first', min(asset), 1.0 FROM an)"""


def days(spark: SparkSession, d: str) -> DataFrame:
    """Staged in a file (a row an asset and day): the plans below use it several times."""
    return staged(C.business_days(P.weekly_prices(spark, d)).select("date", "asset", "price"), "days")


def strategies(prices: DataFrame) -> DataFrame:
    named = portfolios(prices).withColumnRenamed("portfolio", "strategy")
    first = prices.agg(F.min("asset").alias("asset")).select(F.lit("first").alias("strategy"), "asset", F.lit(1.0).alias("weight"))
    return T.normalised(named.unionByName(first), prices)


def _segments(flags: str, weights: str) -> str:
    """value by strategy and date. flags: a query of (strategy, date); weights: a table of (strategy, asset, weight), with
    start where they change."""
    held = "JOIN {w} w ON w.strategy = s.strategy AND w.start = s.start" if "start" in weights else "JOIN {w} w ON w.strategy = s.strategy"
    table = weights.split()[0]
    return f"""names AS (SELECT DISTINCT strategy FROM {table}), dt AS (SELECT DISTINCT date FROM px), fl AS ({flags}),
dy AS (SELECT n.strategy, dt.date, CASE WHEN fl.date IS NULL THEN 0 ELSE 1 END AS flag FROM dt CROSS JOIN names n LEFT JOIN fl ON fl.date = dt.date AND fl.strategy = n.strategy),
sg AS (SELECT *, coalesce(sum(flag) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM dy),
st AS (SELECT strategy, segment + 1 AS segment, max(date) AS start FROM sg GROUP BY 1, 2 UNION ALL SELECT strategy, 0, min(date) FROM sg GROUP BY 1),
bs AS (SELECT s.strategy, s.segment, w.asset, w.weight, p.price AS base FROM st s {held.format(w=table)} JOIN px p ON p.date = s.start AND p.asset = w.asset),
gr AS (SELECT sg.strategy, sg.date, sg.segment, sum(weight * price / base) AS growth FROM sg JOIN bs USING (strategy, segment) JOIN px ON px.date = sg.date AND px.asset = bs.asset GROUP BY 1, 2, 3),
en AS (SELECT strategy, segment, arg_max(growth, date) AS e FROM gr GROUP BY 1, 2),
ch AS (SELECT strategy, segment, coalesce(product(e) OVER (PARTITION BY strategy ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS done FROM en),
vl AS (SELECT strategy, date, 100000 * done * growth AS value FROM gr JOIN ch USING (strategy, segment)),
val AS (SELECT strategy, date, value, coalesce(value / lag(value) OVER (PARTITION BY strategy ORDER BY date) - 1, 0) AS ret FROM vl)"""


MONTHLY_FLAGS = "SELECT strategy, date FROM names CROSS JOIN dt WHERE last_day(date) = date"
STATIC = f"{DAYS}, {STRATEGIES}, {_segments(MONTHLY_FLAGS, 'sw')}"
VALUES = f"SELECT strategy, date, {r('value / 100000', 'value')}, {r('ret', 'ret')} FROM val"


def static_values(spark: SparkSession, d: str) -> DataFrame:
    prices = days(spark, d)
    return T.rebalanced(prices, strategies(prices), T.month_end_dates(prices))


def _scaled(values: DataFrame) -> DataFrame:
    return values.withColumn("value", F.col("value") / 100_000)


@query(f"WITH {STATIC} {VALUES}")
def backtest_static(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(static_values(spark, d))


@query(f"WITH {DAYS}, {STRATEGIES}, {_segments('SELECT strategy, date FROM names CROSS JOIN dt WHERE false', 'sw')} {VALUES}")
def backtest_buy_and_hold(spark: SparkSession, d: str) -> DataFrame:
    prices = days(spark, d)
    return _scaled(T.rebalanced(prices, strategies(prices), prices.select("date").limit(0)))


BT = """lv AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM val),
bd AS (SELECT *, level / max(level) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM lv),
b0 AS (SELECT strategy, arg_max(value, date) / arg_min(value, date) - 1 AS total_return, greatest((max(date) - min(date)) / 365.25, 0.1) AS years, stddev_samp(ret) * sqrt(252) AS annual_vol, min(dd) AS max_drawdown, arg_max(value, date) AS final_value FROM bd GROUP BY 1),
bm AS (SELECT strategy, total_return, pow(1 + total_return, 1 / years) - 1 AS annual_return, annual_vol, (pow(1 + total_return, 1 / years) - 1 - 0.035) / nullif(annual_vol, 0) AS sharpe, max_drawdown, final_value FROM b0)"""


@query(
    f"WITH {STATIC}, {BT} SELECT strategy, {r('total_return', 'total_return')}, {r('annual_return', 'annual_return')}, {r('annual_vol', 'annual_vol')}, {r('sharpe', 'sharpe')}, {r('max_drawdown', 'max_drawdown')}, {r('final_value / 100000', 'final_value')} FROM bm"
)
def backtest_comparison(spark: SparkSession, d: str) -> DataFrame:
    return T.backtest_metrics(static_values(spark, d)).withColumn("final_value", F.col("final_value") / 100_000)


@query(
    f"WITH {STATIC}, {BT} SELECT m.strategy, {r('m.total_return', 'total_return')}, {r('m.sharpe', 'sharpe')}, {r('m.annual_return / nullif(abs(m.max_drawdown), 0)', 'calmar')}, {r('m.total_return - o.total_return', 'excess_return')}, "
    "CAST(row_number() OVER (ORDER BY m.sharpe DESC NULLS LAST, m.strategy) AS INTEGER) AS place FROM bm m JOIN bm o ON o.strategy = 'first'"
)
def backtest_ranking(spark: SparkSession, d: str) -> DataFrame:
    return T.compared(T.backtest_metrics(static_values(spark, d)), "first")


@query(
    f"""WITH {STATIC}, q AS (SELECT strategy, date, CASE WHEN count(ret) OVER w = 252 THEN avg(ret) OVER w * 252 END AS a, CASE WHEN count(ret) OVER w = 252 THEN stddev_samp(ret) OVER w * sqrt(252) END AS v FROM val
  WINDOW w AS (PARTITION BY strategy ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
SELECT strategy, date, {r('a', 'rolling_return')}, {r('v', 'rolling_vol')}, {r('a / nullif(v, 0)', 'rolling_sharpe')} FROM q WHERE v IS NOT NULL"""
)
def backtest_rolling(spark: SparkSession, d: str) -> DataFrame:
    return T.rolling_metrics(static_values(spark, d))


@query(f"WITH {STATIC} SELECT strategy, date, {r('value / first_value(value) OVER (PARTITION BY strategy ORDER BY date)', 'growth')} FROM val")
def backtest_growth(spark: SparkSession, d: str) -> DataFrame:
    return T.growth_of_one(static_values(spark, d))


@query(f"WITH {STATIC} SELECT strategy, date, {r('value / max(value) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1', 'drawdown')} FROM val")
def backtest_drawdowns(spark: SparkSession, d: str) -> DataFrame:
    return T.strategy_drawdowns(static_values(spark, d))


_months = ", ".join(r(f"product(1 + ret) FILTER (month(date) = {m}) - 1", f"m{m}") for m in range(1, 13))


@query(f"WITH {STATIC} SELECT strategy, CAST(year(date) AS INTEGER) AS year, {_months} FROM val GROUP BY 1, 2")
def backtest_monthly_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return T.monthly_heatmap(static_values(spark, d))


@query(f"WITH {DAYS}, {STRATEGIES}, f0 AS (SELECT asset, arg_min(price, date) AS p0 FROM px GROUP BY 1), v AS (SELECT strategy, date, asset, weight * price / p0 AS v FROM px JOIN f0 USING (asset) JOIN sw USING (asset)) SELECT strategy, date, asset, {r('v / sum(v) OVER (PARTITION BY strategy, date)', 'share')} FROM v")
def backtest_allocation(spark: SparkSession, d: str) -> DataFrame:
    prices = days(spark, d)
    return T.allocation_shares(prices, strategies(prices))


@query(
    f"WITH {STATIC}, q AS (SELECT strategy, date, ret, avg(ret) OVER (PARTITION BY strategy) AS m, stddev_samp(ret) OVER (PARTITION BY strategy) AS s FROM val) SELECT strategy, date, {r('greatest(least(ret, m + 2 * s), m - 2 * s)', 'ret')} FROM q"
)
def backtest_clipped(spark: SparkSession, d: str) -> DataFrame:
    return T.clipped_returns(static_values(spark, d), sigmas=2.0).select("strategy", "date", "ret")


MOMENTUM = """rx AS (SELECT * FROM (SELECT date, asset, price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS ret FROM px) WHERE ret IS NOT NULL),
rb AS (SELECT max(date) AS date FROM px GROUP BY date_trunc('month', date)),
mp AS (SELECT date, asset, avg(ret) OVER w AS mean, count(ret) OVER w AS n FROM rx WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)),
mk AS (SELECT date, asset, n, row_number() OVER (PARTITION BY date ORDER BY mean DESC NULLS LAST, asset) AS place FROM mp SEMI JOIN rb USING (date)),
mw AS (SELECT 'momentum' AS strategy, date AS start, asset, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM mk WHERE n < 126 OR place <= 3)"""


@query(f"WITH {DAYS}, {MOMENTUM} SELECT strategy, start AS date, asset, {r('weight', 'weight')} FROM mw")
def backtest_momentum_weights(spark: SparkSession, d: str) -> DataFrame:
    prices = days(spark, d)
    return T.momentum_weights(C.simple_returns(prices), T.previous_dates(prices))


def _momentum(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Prices from the first rebalance with weights on, and the weights."""
    prices = days(spark, d)
    weights = T.momentum_weights(C.simple_returns(prices), T.previous_dates(prices))
    first = weights.agg(F.min("date").alias("_first"))
    return prices.crossJoin(F.broadcast(first)).filter("date >= _first").drop("_first"), weights  # one row


@query(f"WITH {DAYS.replace('px AS', 'p1 AS')}, px AS (SELECT * FROM p1), {MOMENTUM}, p2 AS (SELECT * FROM px WHERE date >= (SELECT min(start) FROM mw)), {_segments('SELECT DISTINCT strategy, start AS date FROM mw', 'mw start').replace('FROM px)', 'FROM p2)').replace('JOIN px p ', 'JOIN p2 p ').replace('JOIN px ON px.date = sg.date AND px.asset', 'JOIN p2 ON p2.date = sg.date AND p2.asset')} {VALUES}")
def backtest_dynamic(spark: SparkSession, d: str) -> DataFrame:
    prices, weights = _momentum(spark, d)
    return _scaled(T.rebalanced(prices, weights, weights.select("strategy", "date").distinct()))


@query(f"WITH {DAYS}, {MOMENTUM}, one AS (SELECT strategy, start, weight FROM mw WHERE asset = (SELECT min(asset) FROM mw)), g AS (SELECT DISTINCT 'momentum' AS strategy, date FROM px) SELECT g.strategy, g.date, {r('o.weight', 'weight')} FROM g ASOF LEFT JOIN one o ON g.strategy = o.strategy AND g.date >= o.start")
def backtest_weights_as_of(spark: SparkSession, d: str) -> DataFrame:
    prices, weights = days(spark, d), _momentum(spark, d)[1]
    first = weights.agg(F.min("asset").alias("_a"))
    one = weights.crossJoin(F.broadcast(first)).filter("asset = _a").select("strategy", "date", "weight")  # one row
    return T.as_of(prices.select(F.lit("momentum").alias("strategy"), "date").distinct(), one)


@query(
    f"""WITH {DAYS}, {MOMENTUM}, dn AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM rx)), mk2 AS (SELECT * FROM dn SEMI JOIN rb USING (date)),
sv AS (SELECT k.date, asset, stddev_samp(ret) AS s FROM mk2 k JOIN dn p ON p.i BETWEEN k.i - 126 AND k.i - 1 JOIN rx ON rx.date = p.date GROUP BY 1, 2),
iv AS (SELECT date, asset, CASE WHEN s > 0 THEN 1 / s ELSE 0 END AS part FROM sv WHERE s IS NOT NULL), tt AS (SELECT *, sum(part) OVER (PARTITION BY date) AS total FROM iv)
SELECT 'callback' AS strategy, date, asset, {r('part / total', 'weight')} FROM tt WHERE total > 0"""
)
def backtest_callback(spark: SparkSession, d: str) -> DataFrame:
    """Inverse volatility by a Python allocator, monthly."""
    prices = days(spark, d)
    return T.callback_weights(C.simple_returns(prices), T.previous_dates(prices), lambda history, at: (1 / history.std()).replace(float("inf"), 0).dropna().to_dict(), rows=126)


def rules(spark: SparkSession, macro_factors: tuple[str, str], assets: list[str]) -> DataFrame:
    a, b = macro_factors
    rows = [(1, a, 190_000.0, "above", assets[0], 0.8), (1, a, 190_000.0, "above", assets[1], 0.2), (1, a, 190_000.0, "below", assets[2], 0.7), (1, a, 190_000.0, "below", assets[3], 0.3)]
    rows += [(2, b, 190_000.0, s, assets[k], 1.0) for s, k in (("above", 4), ("below", 5))]
    return spark.createDataFrame(rows, "priority int, factor string, threshold double, side string, asset string, weight double")


RULES = """an2 AS (SELECT asset, row_number() OVER (ORDER BY asset) AS i FROM (SELECT DISTINCT asset FROM panel)),
ru AS (SELECT v.* EXCLUDE (i), asset FROM (VALUES (1, '1-URGENT', 190000.0, 'above', 0.8, 1), (1, '1-URGENT', 190000.0, 'above', 0.2, 2), (1, '1-URGENT', 190000.0, 'below', 0.7, 3), (1, '1-URGENT', 190000.0, 'below', 0.3, 4),
  (2, '2-HIGH', 190000.0, 'above', 1.0, 5), (2, '2-HIGH', 190000.0, 'below', 1.0, 6)) v(priority, factor, threshold, side, weight, i) JOIN an2 USING (i)),
mh AS (SELECT * FROM macro WHERE NOT (factor = '1-URGENT' AND month(date) IN (3, 7)))"""


def _macro_holed(spark: SparkSession, d: str) -> DataFrame:
    return P.monthly_macro(spark, d).filter(~((F.col("factor") == "1-URGENT") & F.month("date").isin(3, 7)))


MACRO_WEIGHTS = f"""{RULES}, kn AS (SELECT m.date, u.priority, CASE WHEN m.value > u.threshold THEN 'above' ELSE 'below' END AS side FROM mh m JOIN (SELECT DISTINCT priority, factor, threshold FROM ru) u USING (factor)
  QUALIFY row_number() OVER (PARTITION BY date ORDER BY priority) = 1), mwt AS (SELECT 'macro' AS strategy, date, asset, weight / sum(weight) OVER (PARTITION BY date) AS weight FROM kn JOIN ru USING (priority, side))"""


@query(f"WITH {WEEKLY}, {MACRO}, {MACRO_WEIGHTS} SELECT strategy, date, asset, {r('weight', 'weight')} FROM mwt")
def backtest_macro_weights(spark: SparkSession, d: str) -> DataFrame:
    assets = sorted(x["asset"] for x in P.weekly_prices(spark, d).select("asset").distinct().collect())
    return T.macro_weights(_macro_holed(spark, d), rules(spark, ("1-URGENT", "2-HIGH"), assets))


@query(f"WITH {WEEKLY}, {MACRO}, {RULES} SELECT date, factor, CASE WHEN value > 190000 THEN 1 ELSE -1 END AS signal FROM mh WHERE factor IN ('1-URGENT', '2-HIGH')")
def backtest_signals(spark: SparkSession, d: str) -> DataFrame:
    assets = sorted(x["asset"] for x in P.weekly_prices(spark, d).select("asset").distinct().collect())
    return T.signals(_macro_holed(spark, d), rules(spark, ("1-URGENT", "2-HIGH"), assets))


@query(
    f"""WITH {DAYS}, {MACRO}, {MACRO_WEIGHTS}, fd AS (SELECT min(date) AS date FROM px), t0 AS (SELECT min(date) AS date FROM px GROUP BY date_trunc('month', date)),
al AS (SELECT strategy, (SELECT min(p.date) FROM px p WHERE date_trunc('month', p.date) = mwt.date) AS start, asset, weight FROM mwt), mw AS (SELECT * FROM al WHERE start IS NOT NULL),
p2 AS (SELECT * FROM px WHERE date >= (SELECT min(start) FROM mw)), {_segments('SELECT DISTINCT strategy, start AS date FROM mw', 'mw start').replace('FROM px)', 'FROM p2)').replace('JOIN px p ', 'JOIN p2 p ').replace('JOIN px ON px.date = sg.date AND px.asset', 'JOIN p2 ON p2.date = sg.date AND p2.asset')} {VALUES}"""
)
def backtest_macro(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a month's factors, traded at the close of its first date."""
    prices = days(spark, d)
    assets = sorted(x["asset"] for x in P.weekly_prices(spark, d).select("asset").distinct().collect())
    targets = T.macro_weights(_macro_holed(spark, d), rules(spark, ("1-URGENT", "2-HIGH"), assets))
    firsts = prices.groupBy(F.trunc("date", "MM").alias("month")).agg(F.min("date").alias("traded"))
    weights = targets.join(firsts, F.col("date") == F.col("month")).select("strategy", F.col("traded").alias("date"), "asset", "weight")
    begin = weights.agg(F.min("date").alias("_first"))
    return _scaled(T.rebalanced(prices.crossJoin(F.broadcast(begin)).filter("date >= _first").drop("_first"), weights, weights.select("strategy", "date").distinct()))  # one row


@query(
    f"WITH {MACRO} SELECT date, factor, {r('(value / nullif(lag(value, 12) OVER w, 0) - 1) * 100', 'pct_change')}, {r('value - lag(value, 12) OVER w', 'difference', 4)}, "
    f"{r('CASE WHEN count(value) OVER z = 12 THEN (value - avg(value) OVER z) / nullif(stddev_samp(value) OVER z, 0) END', 'z_score')} "
    "FROM macro WINDOW w AS (PARTITION BY factor ORDER BY date), z AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
)
def backtest_derived_factors(spark: SparkSession, d: str) -> DataFrame:
    macro = P.monthly_macro(spark, d)
    kinds = {"pct_change_yoy": "pct_change", "diff_yoy": "difference", "z_score": "z_score"}
    frames = [T.derived_factor(macro, k, 12).withColumnRenamed("value", n) for k, n in kinds.items()]
    joined = frames[0].join(frames[1], ["date", "factor"]).join(frames[2], ["date", "factor"])
    return joined.withColumn("difference", F.round(F.col("difference") + 3e-8, 4))


HISTORY = f"{PORT}, h AS (SELECT date, ret FROM p WHERE portfolio = 'equal')"


def history(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    return R.portfolio_returns(returns, portfolios(returns)).filter("portfolio = 'equal'").select("date", "ret")


PATHS, HORIZON = 200, 60
GRID = f"g AS (SELECT a.range AS path, CAST(b.range AS INTEGER) AS day FROM range({PATHS}) a CROSS JOIN range(1, {HORIZON + 1}) b)"
KEY = "path::VARCHAR || '-' || day::VARCHAR"
DRAWS = {
    "parametric": f"dr AS (SELECT path, day, m + s * sqrt(-2 * ln({UNIFORM.format(seed='mc-u', key=KEY)} + 0.5 / 4294967296.0::DOUBLE)) * cos(2 * pi() * {UNIFORM.format(seed='mc-v', key=KEY)}) AS ret FROM g CROSS JOIN (SELECT avg(ret) AS m, stddev_samp(ret) AS s FROM h))",
    "historical": f"hn AS (SELECT row_number() OVER (ORDER BY date) - 1 AS place, ret FROM h), dr AS (SELECT path, day, ret FROM (SELECT path, day, CAST(floor({UNIFORM.format(seed='mc', key=KEY)} * (SELECT count(*) FROM h)) AS BIGINT) AS place FROM g) JOIN hn USING (place))",
    "block_bootstrap": f"hn AS (SELECT row_number() OVER (ORDER BY date) - 1 AS place, ret FROM h), g2 AS (SELECT *, CAST(floor((day - 1) / 20) AS BIGINT) AS block FROM g), dr AS (SELECT path, day, ret FROM (SELECT path, day, CAST(floor({UNIFORM.format(seed='mc', key="path::VARCHAR || '-' || block::VARCHAR")} * ((SELECT count(*) FROM h) - 20)) AS BIGINT) + (day - 1) % 20 AS place FROM g2) JOIN hn USING (place))",
}
PATH_VALUES = "pv AS (SELECT path, day, 100000 * product(1 + ret) OVER (PARTITION BY path ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM dr)"


def _simulated(method: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _scaled(getattr(M, method)(history(spark, d), PATHS, HORIZON))

    run.__name__ = f"simulate_{method}"
    return run


for _method, _draws in DRAWS.items():
    query(f"WITH {HISTORY}, {GRID}, {_draws}, {PATH_VALUES} SELECT path, day, {r('value / 100000', 'value')} FROM pv")(_simulated(_method))

SIM = f"{HISTORY}, {GRID}, {DRAWS['parametric']}, {PATH_VALUES}"
_prob = lambda t: f"prob_{'minus_' if t < 0 else ''}{abs(round(t * 100))}"
FINAL = f"""{SIM}, fv AS (SELECT path, value / 100000 AS v FROM pv WHERE day = {HORIZON}),
fs AS (SELECT avg(v) AS mean, quantile_cont(v, 0.5) AS median, min(v) AS min, max(v) AS max, stddev_pop(v) AS std, pow(avg(v), 252.0 / {HORIZON}) - 1 AS annualized_return,
  {", ".join(f"quantile_cont(v, {p / 100}) AS percentile_{p}" for p in M.PERCENTILES)}, {", ".join(f"avg(CASE WHEN v >= {1 + t} THEN 1.0 ELSE 0.0 END) AS {_prob(t)}" for t in M.TARGETS)} FROM fv)"""
FINAL_COLUMNS = ["mean", "median", "min", "max", "std", "annualized_return", *(f"percentile_{p}" for p in M.PERCENTILES), *(_prob(t) for t in M.TARGETS)]


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return M.parametric(history(spark, d), PATHS, HORIZON, initial=1.0)


@query(f"WITH {FINAL} SELECT {', '.join(r(c, c) for c in FINAL_COLUMNS)} FROM fs")
def simulate_final_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.final_stats(_paths(spark, d), 1.0)


@query(f"WITH {FINAL} " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS target, {r(_prob(t), 'probability')} FROM fs" for t in M.TARGETS))
def simulate_targets(spark: SparkSession, d: str) -> DataFrame:
    return M.target_table(M.final_stats(_paths(spark, d), 1.0)).withColumn("target", F.col("target").cast("decimal(4,1)")).withColumn("target", F.col("target").cast("double"))


@query(f"WITH {SIM} SELECT day, {r('quantile_cont(value, 0.05) / 100000', 'p5')}, {r('quantile_cont(value, 0.5) / 100000', 'p50')}, {r('quantile_cont(value, 0.95) / 100000', 'p95')} FROM pv GROUP BY day")
def simulate_bands(spark: SparkSession, d: str) -> DataFrame:
    return M.bands(_paths(spark, d))


@query(f"WITH {SIM}, k AS (SELECT range AS path FROM range({PATHS}) ORDER BY md5('sample-' || range::VARCHAR), range LIMIT 20) SELECT path, day, {r('value / 100000', 'value')} FROM pv SEMI JOIN k USING (path)")
def simulate_sample(spark: SparkSession, d: str) -> DataFrame:
    return M.sampled_paths(_paths(spark, d), 20).select("path", "day", "value")


def _full(method: str):
    """The operator's own defaults: 1000 paths of 1260 days."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return getattr(M, method)(history(spark, d))

    run.__name__ = f"simulate_full_{method}"
    return run


# without SQL: values reach 1e15, where two engines' sixth decimals differ; a test holds them against SQL by ratio
for _method in DRAWS:
    query()(_full(_method))


@query()
def simulate_full_final_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.final_stats(M.parametric(history(spark, d)))


@query()
def simulate_full_targets(spark: SparkSession, d: str) -> DataFrame:
    return M.target_table(M.final_stats(M.parametric(history(spark, d))))


@query()
def simulate_full_bands(spark: SparkSession, d: str) -> DataFrame:
    return M.bands(M.parametric(history(spark, d)))


@query()
def simulate_full_sample(spark: SparkSession, d: str) -> DataFrame:
    return M.sampled_paths(M.parametric(history(spark, d)))


def _scenario_sql(scenarios: dict[str, list[float]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS scenario, unnest(range(1, {len(v) + 1})) AS step, unnest({v!r}::DOUBLE[]) AS ret" for k, v in scenarios.items())


STRESS = f"""sv AS (SELECT scenario, step, 100000 * product(1 + ret) OVER (PARTITION BY scenario ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM sc),
sx AS (SELECT *, v / max(v) OVER (PARTITION BY scenario ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM sv)
SELECT scenario, {r('100000.0::DOUBLE', 'initial_value')}, {r('arg_max(v, step)', 'final_value')}, {r('arg_max(v, step) / 100000 - 1', 'total_return')}, {r('min(dd)', 'max_drawdown')}, count(*) AS days FROM sx GROUP BY scenario"""


@query(f"WITH sc AS ({_scenario_sql(M.SCENARIOS | {'default': M.DEFAULT_PATH})}), {STRESS}")
def stress_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return M.stress(M.scenario_frame(spark, M.SCENARIOS | {"default": []}))


@query(
    f"""WITH {HISTORY}, wn AS (SELECT * FROM (VALUES ('first', DATE '1994-01-10', DATE '1994-06-06'), ('second', DATE '1996-01-08', DATE '1997-01-06'), ('absent', DATE '1996-01-09', DATE '1996-06-03')) w(scenario, a, b)),
ok AS (SELECT * FROM wn WHERE a IN (SELECT date FROM h) AND b IN (SELECT date FROM h)), sc AS (SELECT scenario, row_number() OVER (PARTITION BY scenario ORDER BY date) AS step, ret FROM ok JOIN h ON date BETWEEN a AND b), {STRESS}"""
)
def stress_windows(spark: SparkSession, d: str) -> DataFrame:
    windows = spark.sql("SELECT * FROM VALUES ('first', DATE '1994-01-10', DATE '1994-06-06'), ('second', DATE '1996-01-08', DATE '1997-01-06'), ('absent', DATE '1996-01-09', DATE '1996-06-03') AS t(scenario, start, end)")
    return M.stress(M.window_scenarios(history(spark, d), windows))


@query(f"WITH {PORT}, w2 AS (SELECT * FROM pw UNION ALL SELECT 'equal_weight', asset, 1.0 / count(*) OVER () FROM a) SELECT portfolio, asset, {r('weight', 'weight')} FROM w2")
def report_portfolio_weights(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    named = portfolios(returns).withColumnRenamed("portfolio", "strategy")
    return D.portfolio_weights(T.normalised(named, returns).withColumnRenamed("strategy", "portfolio"))


@query(f"WITH {WEEKLY_RETURNS}, {VOL} SELECT asset, 'annual_vol' AS metric, {r('annual_vol', 'value')} FROM vol UNION ALL SELECT asset, 'ewma_vol', {r('ewma_vol', 'value')} FROM vol")
def report_melted_metrics(spark: SparkSession, d: str) -> DataFrame:
    return D.melted(R.volatility(weekly_returns(spark, d)), ["annual_vol", "ewma_vol"])


@query(f"WITH {WEEKLY_RETURNS}, {VOL}, {DD}, {PERF} SELECT asset, {r('annual_vol', 'annual_vol')}, {r('max_drawdown', 'max_drawdown')}, {r('sharpe', 'sharpe')} FROM vol LEFT JOIN draw USING (asset) LEFT JOIN perf USING (asset)")
def report_key_metrics(spark: SparkSession, d: str) -> DataFrame:
    returns, prices = weekly_returns(spark, d), P.weekly_prices(spark, d)
    return D.key_metrics(R.volatility(returns), R.drawdowns(prices), R.performance(returns, prices, "STANDARD"))


@query(f"WITH {WEEKLY_RETURNS}, {PAIRS} SELECT asset_i, asset_j, {r('correlation', 'correlation')} FROM pairs WHERE asset_i > asset_j")
def report_correlation_triangle(spark: SparkSession, d: str) -> DataFrame:
    return D.upper_triangle(V.pair_stats(weekly_returns(spark, d))).select("asset_i", "asset_j", "correlation")


@query(f"WITH {STATIC}, x AS (SELECT strategy, date, value / max(value) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM val) SELECT strategy, {r('min(dd)', 'max_drawdown')} FROM x GROUP BY 1")
def report_drawdown_summary(spark: SparkSession, d: str) -> DataFrame:
    """Without the date, which rounding of equal depths decides."""
    return D.drawdown_summary(T.strategy_drawdowns(static_values(spark, d))).drop("date")


@query(f"WITH {PORT} SELECT portfolio, asset, {r('weight', 'weight')}, CAST(row_number() OVER (PARTITION BY portfolio ORDER BY weight DESC, asset) AS INTEGER) AS place FROM pw QUALIFY place <= 3")
def report_top_holdings(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    weights = T.normalised(portfolios(returns).withColumnRenamed("portfolio", "strategy"), returns).withColumnRenamed("strategy", "portfolio")
    return D.top_holdings(weights, 3)


@query(f"WITH {PORT} SELECT portfolio, asset, {r('weight', 'weight')} FROM pw WHERE weight > 0.15")
def portfolio_held(spark: SparkSession, d: str) -> DataFrame:
    """The assets that a portfolio holds more than a sliver of."""
    returns = weekly_returns(spark, d)
    weights = T.normalised(portfolios(returns).withColumnRenamed("portfolio", "strategy"), returns).withColumnRenamed("strategy", "portfolio")
    return O.held(weights, 0.15)


@query(f"WITH {PORT} SELECT portfolio, CASE WHEN weight > 0.15 THEN asset ELSE 'Other' END AS asset, {r('sum(weight)', 'weight')} FROM pw GROUP BY 1, 2")
def report_bucketed(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    weights = T.normalised(portfolios(returns).withColumnRenamed("portfolio", "strategy"), returns).withColumnRenamed("strategy", "portfolio")
    return D.bucketed(weights, 0.15)


@query(f"WITH {WEEKLY} SELECT date, asset, {r('price', 'price')} FROM panel")
def report_wide_and_long(spark: SparkSession, d: str) -> DataFrame:
    """Out to a column for each asset and back."""
    return D.long(D.wide(P.weekly_prices(spark, d)))


_stat_union = " UNION ALL ".join(f"SELECT '{s}' AS statistic, portfolio, {c} AS value FROM b" for s, c in (("annual_return", "annual_return"), ("annual_vol", "annual_vol")))


@query(f"WITH {PORT}, t AS ({_stat_union}) SELECT statistic, {r("max(value) FILTER (portfolio = 'equal')", 'equal')}, {r("max(value) FILTER (portfolio = 'by_name')", 'by_name')} FROM t GROUP BY 1")
def report_stat_by_method(spark: SparkSession, d: str) -> DataFrame:
    returns = weekly_returns(spark, d)
    return D.stat_by_method(R.portfolio_metrics(returns, portfolios(returns)), ["annual_return", "annual_vol"], ["equal", "by_name"], "portfolio")


@query(f"WITH {STATIC}, {BT} SELECT 'conservative' AS profile, 'equal' AS strategy UNION ALL SELECT 'balanced', arg_max(strategy, sharpe) FROM bm WHERE strategy IN ('equal', 'by_name') UNION ALL SELECT 'aggressive', arg_max(strategy, sharpe) FROM bm WHERE strategy IN ('by_name', 'first')")
def report_recommended(spark: SparkSession, d: str) -> DataFrame:
    metrics = T.backtest_metrics(static_values(spark, d)).select("strategy", "sharpe")
    return D.recommended(metrics, "equal", [("equal", "by_name"), ("by_name", "first")])


@query(f"WITH {STATIC}, {BT} SELECT 'best' AS kind, strategy, {r('sharpe', 'sharpe')}, CAST(NULL AS DOUBLE) AS value FROM (SELECT * FROM bm ORDER BY sharpe DESC, strategy LIMIT 1) UNION ALL SELECT 'last', strategy, NULL, {r('arg_max(value, date) / 100000', 'value')} FROM val GROUP BY strategy")
def report_union(spark: SparkSession, d: str) -> DataFrame:
    """Tagged frames with unlike columns, below each other."""
    values = static_values(spark, d)
    best = T.backtest_metrics(values).orderBy(F.desc("sharpe"), "strategy").limit(1).select("strategy", "sharpe")
    last = values.groupBy("strategy").agg((F.max_by("value", "date") / 100_000).alias("value"))
    return D.union_tagged({"best": best, "last": last}, "kind")
