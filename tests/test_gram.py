"""Pair moments by columns and by tiles against the join of the panel with itself."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import gram


def joined(returns):
    a = returns.select("date", F.col("asset").alias("asset_i"), F.col("ret").alias("x"))
    b = returns.select("date", F.col("asset").alias("asset_j"), F.col("ret").alias("y"))
    return a.join(b, "date").filter("x IS NOT NULL AND y IS NOT NULL").groupBy("asset_i", "asset_j").agg(F.try_divide(F.covar_samp("x", "y"), F.sqrt(F.var_samp("x") * F.var_samp("y"))).alias("correlation"), F.covar_samp("x", "y").alias("cov"))


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(4)
    start = datetime.date(2020, 1, 1)
    rows = [(start + datetime.timedelta(days=d), f"a{k:02}", rng.gauss(100.0 if k == 3 else 0.0, 0.01)) for d in range(600) for k in range(9) if rng.random() < (0.4 if k == 5 else 0.95)]
    rows += [(start, "once", 0.1), (start + datetime.timedelta(days=900), "alone", 0.1), (start + datetime.timedelta(days=5), "null", None)]
    rows += [(start + datetime.timedelta(days=d), "flat", 0.25) for d in range(40)]
    return spark.createDataFrame(rows, "date date, asset string, ret double").cache()


def plain(frame):
    return {(r["asset_i"], r["asset_j"]): (r["correlation"], r["cov"]) for r in frame.collect()}


@pytest.mark.parametrize("ways", [{"few": 20}, {"few": 0}, {"few": 0, "block": 4, "stripes": 3}, {"few": 0, "block": 1, "stripes": 1}])
def test_pairs(panel, ways):
    want, got = plain(joined(panel)), plain(gram.pair_stats(panel, **ways))
    assert set(got) == set(want)
    for pair, values in want.items():
        for a, b in zip(got[pair], values, strict=True):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, abs=1e-12))


def test_no_rows(spark, panel):
    assert gram.pair_stats(panel.limit(0)).count() == 0


def test_the_plan_joins_no_dates(panel):
    for few in (0, 20):
        plan = gram.pair_stats(panel, few)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
