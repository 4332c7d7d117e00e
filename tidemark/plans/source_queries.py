"""Sources and sinks as round trips through files, against the SQL of what was written; and runs of several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report as D
from ..operators import suites as S
from ..sources import files, payload_source, synthetic
from ..sources import panels as P
from .registry import MACRO, WEEKLY, WEEKLY_RETURNS, query, r
from .strategy_queries import FINAL, FINAL_COLUMNS, HISTORY, HORIZON, PATHS, history
from .validation_queries import weekly_returns

PANEL = f"WITH {WEEKLY} SELECT date, asset, {r('price', 'price')} FROM panel"


@query(PANEL)
def source_wide_csv(spark: SparkSession, d: str) -> DataFrame:
    path = files.workspace(spark, "wide")
    files.write_wide_csv(P.weekly_prices(spark, d), path)
    return files.read_wide_csv(spark, path)


@query(f"WITH {WEEKLY} SELECT lower(asset) AS name, date, asset, {r('price', 'price')} FROM panel WHERE asset IN ('STANDARD', 'SMALL')")
def source_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file for each of two assets, read by a glob with the asset from the file's name."""
    base, panel = files.workspace(spark, "json"), P.weekly_prices(spark, d)
    for asset in ("STANDARD", "SMALL"):
        files.write_json(panel.filter(F.col("asset") == asset).coalesce(1), f"{base}/stats_{asset.lower()}")
    found = files.read_records(spark, f"{base}/stats_*/*.json", r"stats_([a-z]+)/", "name", multiline=False)
    return found.select("name", F.to_date("date").alias("date"), "asset", "price")


@query(f"WITH {WEEKLY} SELECT lower(asset) AS name, date, {r('price', 'price')} FROM panel WHERE asset IN ('STANDARD', 'SMALL')")
def source_tagged_csv(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files for each asset, read by a glob; the name comes from the path."""
    base = files.workspace(spark, "tagged")
    panel = P.weekly_prices(spark, d)
    for asset in ("STANDARD", "SMALL"):
        panel.filter(F.col("asset") == asset).select("date", "price").write.option("header", True).csv(f"{base}/prices_{asset.lower()}")
    return files.read_tagged_csv(spark, f"{base}/prices_*", "date date, price double", r"prices_([a-z]+)/", "name").select("name", "date", "price")


@query(f"WITH {WEEKLY} SELECT date, asset, {r('2 * price', 'price')} FROM panel")
def source_newest(spark: SparkSession, d: str) -> DataFrame:
    """Of two files the one written last; the other isn't opened."""
    base, panel = files.workspace(spark, "newest"), P.weekly_prices(spark, d)
    for name, times in (("b", 1), ("a", 2)):
        panel.withColumn("price", F.col("price") * times).coalesce(1).write.parquet(f"{base}/{name}")
    return spark.read.parquet(files.newest(spark, f"{base}/*"))


@query(f"WITH {WEEKLY} SELECT date, asset, {r('price', 'price')} FROM panel WHERE asset IN ('STANDARD', 'SMALL') AND date >= DATE '1996-06-01' AND date < DATE '1998-07-01'")
def source_payload_format(spark: SparkSession, d: str) -> DataFrame:
    """Service documents, one a year and asset, opened by the registered format; both filters reach it."""
    base, panel = files.workspace(spark, "payloads"), P.weekly_prices(spark, d)
    day = F.struct(F.col("date").cast("string").alias("k"), F.create_map(F.lit("4. close"), F.col("price").cast("string")).alias("v"))
    years = panel.groupBy("asset", F.year("date").alias("year")).agg(F.map_from_entries(F.collect_list(day)).alias("days"))  # at most a year of days
    years.select("asset", F.to_json(F.struct(F.col("days").alias("Time Series (Daily)"))).alias("value")).write.partitionBy("asset").text(base)
    payload_source.register(spark)
    return spark.read.format("payloads").load(base).filter("asset IN ('STANDARD', 'SMALL') AND date >= DATE '1996-06-01' AND date < DATE '1998-07-01'")


@query(PANEL)
def source_cached(spark: SparkSession, d: str) -> DataFrame:
    """Built once, read twice."""
    path, panel = files.workspace(spark, "cache"), P.weekly_prices(spark, d)
    files.cached(spark, path, {"panel": "weekly"}, panel, lambda: panel)

    def again() -> DataFrame:
        raise AssertionError("the cache wasn't met")

    return files.cached(spark, path, {"panel": "weekly"}, panel, again)


@query(f"WITH {WEEKLY}, {MACRO}, w AS (SELECT count(*) AS n_prices, CAST(count(DISTINCT asset) AS INTEGER) AS n_assets, min(date) AS first_date, max(date) AS last_date FROM panel), m AS (SELECT count(*) AS n_macro, array_to_string(list_sort(list(DISTINCT factor)), ',') AS factors FROM macro) SELECT *, 'absent' AS missing, 'tables' AS source FROM w CROSS JOIN m")
def source_metadata(spark: SparkSession, d: str) -> DataFrame:
    panel = P.weekly_prices(spark, d)
    names = [*sorted(x["asset"] for x in panel.select("asset").distinct().collect()), "absent"]  # a name an asset
    found = files.collection_metadata(panel, P.monthly_macro(spark, d), names, "tables")
    return found.withColumns({c: F.array_join(c, ",") for c in ("factors", "missing")})


@query(f"WITH {WEEKLY} SELECT date, asset, {r('price', 'price')}, 'tables' AS source FROM panel")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A reader that fails, one with too few assets, the tables; a synthetic panel would be the last."""
    panel = P.weekly_prices(spark, d)
    names = sorted(x["asset"] for x in panel.select("asset").distinct().collect())  # a name an asset
    readers = [
        ("absent", lambda: spark.read.parquet(files.workspace(spark, "absent"))),
        ("few", lambda: panel.filter(F.col("asset") == names[0])),
        ("tables", lambda: panel),
        ("synthetic", lambda: synthetic.prices(spark, {n: (100, 0.0003, 0.01) for n in names}, "2020-01-01", "2020-12-31")),
    ]
    name, found = files.first_with_rows(readers, names)
    return found.withColumn("source", F.lit(name))


@query(f"WITH {MACRO} SELECT date, factor, {r('value', 'value', 2)}, CASE WHEN factor = '1-URGENT' THEN 'first' ELSE 'second' END AS source FROM macro WHERE factor IN ('1-URGENT', '2-HIGH')", digits=2)
def source_fallback_by_factor(spark: SparkSession, d: str) -> DataFrame:
    macro = P.monthly_macro(spark, d)
    readers = [("first", lambda f: macro.filter(F.col("factor") == f).filter("factor = '1-URGENT'")), ("second", lambda f: macro.filter(F.col("factor") == f))]
    return files.each_factor(readers, ["1-URGENT", "2-HIGH", "absent"])


_PORTFOLIOS = ["max_sharpe", "min_volatility", "risk_parity", *(f"target_{k}" for k in range(10)), *(f"curve_{k}" for k in range(30))]


@query(f"SELECT unnest({_PORTFOLIOS!r}) AS portfolio, 1.0::DOUBLE AS budget")
def suite_optimizations(spark: SparkSession, d: str) -> DataFrame:
    weights, _ = S.optimizations(weekly_returns(spark, d), random=100)
    return weights.groupBy("portfolio").agg(F.sum("weight").alias("budget"))


@query("SELECT unnest(['equilibrium', 'one', 'absolute', 'relative', 'both']) AS views, 1.0::DOUBLE AS budget")
def suite_views(spark: SparkSession, d: str) -> DataFrame:
    return S.view_portfolios(weekly_returns(spark, d)).groupBy("views").agg(F.sum("weight").alias("budget"))


@query("SELECT unnest(['factor_sharpe', 'factor_min_variance']) AS portfolio, 1.0::DOUBLE AS budget, 'optimal' AS status")
def suite_factor_portfolios(spark: SparkSession, d: str) -> DataFrame:
    """The tilts of the suite may have no weights on a panel; the objectives always do."""
    found = S.factor_portfolios(weekly_returns(spark, d)).filter("portfolio LIKE 'factor%'")
    return found.groupBy("portfolio", "status").agg(F.sum("weight").alias("budget"))


@query(f"WITH {FINAL} SELECT {', '.join(r(c, c) for c in FINAL_COLUMNS)} FROM fs")
def suite_simulation(spark: SparkSession, d: str) -> DataFrame:
    """The run with a cache, met the second time."""
    own, path = history(spark, d), files.workspace(spark, "simulation")
    for _ in range(2):
        found = S.simulation(own, path, "parametric", PATHS, HORIZON, 1.0)
    return found


@query(
    f"WITH {WEEKLY_RETURNS}, h0 AS (SELECT * FROM r WHERE NOT (asset = 'STANDARD' AND month(date) = 3)), n AS (SELECT 1.0 / count(DISTINCT asset) AS weight FROM h0), "
    f"p AS (SELECT date, sum(weight * ret) / sum(weight) AS ret FROM h0 CROSS JOIN n GROUP BY 1) SELECT date, {r('ret', 'ret')} FROM p"
)
def suite_available_history(spark: SparkSession, d: str) -> DataFrame:
    """Equal parts by default, of the assets that there are: one has no rows in each March."""
    returns = weekly_returns(spark, d).filter("NOT (asset = 'STANDARD' AND month(date) = 3)")
    return S.available_history(returns, S.default_weights(returns))


_rules = ", ".join(f"({p}, '{f}', {t}, '{side}', '{asset}', {w})" for p, f, t, side, action in ((1, *S.DEFAULT_RULES[0]), (1, *S.DEFAULT_RULES[1]), (3, *S.DEFAULT_RULES[4]), (3, *S.DEFAULT_RULES[5])) for asset, w in action.items())


@query(f"SELECT priority, factor, threshold::DOUBLE AS threshold, side, asset, weight::DOUBLE AS weight FROM (VALUES {_rules}) v(priority, factor, threshold, side, asset, weight)")
def suite_default_rules(spark: SparkSession, d: str) -> DataFrame:
    """Of a panel with policy rates and volatility but no consumer prices."""
    macro = P.monthly_macro(spark, d).filter("factor IN ('1-URGENT', '2-HIGH')")
    named = macro.withColumn("factor", F.when(F.col("factor") == "1-URGENT", "FEDFUNDS").otherwise("VIX"))
    return S.default_rules(named)[1]


@query(f"WITH {FINAL} " + " UNION ALL ".join(f"SELECT 'parametric' AS method, {p} AS percentile, {r(f'percentile_{p}', 'value')} FROM fs" for p in (1, 5, 10, 25, 50, 75, 90, 95, 99)))
def report_percentiles(spark: SparkSession, d: str) -> DataFrame:
    own = history(spark, d)
    stats = S.simulate.final_stats(S.simulate.parametric(own, PATHS, HORIZON, initial=1.0), 1.0)
    return D.percentiles(stats.withColumn("method", F.lit("parametric")))


@query(f"WITH {HISTORY} SELECT 'history' AS kind, count(*) AS n FROM h UNION ALL SELECT 'sample', 20 AS n")
def report_sampled(spark: SparkSession, d: str) -> DataFrame:
    """A sample beside the whole, each with its name."""
    own = history(spark, d)
    both = D.union_tagged({"history": own, "sample": D.sampled(own, 20, "date")}, "kind")
    return both.groupBy("kind").agg(F.count("*").alias("n"))
