"""Runs of several operators against the operators themselves."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, cleaning, suites
from tidemark.sources import synthetic


@pytest.fixture(scope="module")
def prices(spark):
    return synthetic.prices(spark, {k: (100, 0.0002 * i, 0.01) for i, k in enumerate("abcde")}, "2020-01-01", "2021-03-31")


def test_default_rules_decide_by_the_first_factor_there_is(spark):
    dates = [f"20{20 + k // 12}-{k % 12 + 1:02d}-01" for k in range(14)]
    rows = [(d, "CPIAUCSL", 100.0 * 1.06 ** (k / 12)) for k, d in enumerate(dates)] + [(dates[13], "VIX", 20.0), (dates[0], "VIX", 30.0)]
    macro = spark.createDataFrame(rows, "date string, factor string, value double")
    every, rules = suites.default_rules(macro, 12)
    assert {r["factor"] for r in rules.collect()} == {"CPIAUCSL_YOY", "VIX"}
    got = {}
    for r in backtest.macro_weights(every, rules).collect():
        got.setdefault(r["date"], {})[r["asset"]] = round(r["weight"], 9)
    assert got == {dates[0]: {"TLT": 0.6, "SPY": 0.2, "GLD": 0.2}, dates[12]: {"GLD": 0.3, "TIP": 0.3, "SPY": 0.4}, dates[13]: {"GLD": 0.3, "TIP": 0.3, "SPY": 0.4}}


def test_backtests_of_a_suite_are_those_of_its_strategies(spark, prices):
    returns = cleaning.simple_returns(prices)
    equal = prices.select("asset").distinct().select(F.lit("equal").alias("strategy"), "asset", F.lit(0.2).alias("weight"))
    got = {r["strategy"]: r for r in suites.backtests(prices, returns, equal).collect()}
    alone = backtest.backtest_metrics(backtest.rebalanced(prices, equal, backtest.month_end_dates(prices))).first()
    assert set(got) == {"equal", "momentum"} and got["equal"]["sharpe"] == pytest.approx(alone["sharpe"])


def test_factor_portfolios_use_cached_factors_with_enough_dates(spark, prices):
    returns = cleaning.simple_returns(prices)
    few = spark.createDataFrame([("2020-01-02", "MKT", 0.1)], "date string, factor string, value double").withColumn("date", F.to_date("date"))
    made = suites.factor_portfolios(returns)
    assert made.count() == suites.factor_portfolios(returns, few).count()
    own = returns.groupBy("date").agg(F.avg("ret").alias("value")).select("date", F.lit("MKT").alias("factor"), "value")
    cached = suites.factor_portfolios(returns, own)
    assert {r["portfolio"] for r in cached.collect()} >= {"factor_sharpe", "factor_min_variance"}


def test_saved_weights_come_first(spark, prices):
    returns = cleaning.simple_returns(prices)
    saved = spark.createDataFrame([("a", 1.0)], "asset string, weight double")
    assert suites.default_weights(returns, saved).count() == 1
    assert {round(r["weight"], 9) for r in suites.default_weights(returns, saved.limit(0)).collect()} == {0.2}
