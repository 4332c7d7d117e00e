"""Quantiles by brackets against the built-in ones and against sorting in NumPy."""

import math
import random

import numpy as np
import pytest

from tidemark.functions import quantiles
from tidemark.operators import risk

SHARES = {"low": 0.0, "q005": 0.005, "q05": 0.05, "half": 0.5, "q995": 0.995, "top": 1.0}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(7)
    found = [("wide", draw.lognormvariate(0, 3)) for _ in range(3000)]
    found += [("tied", float(draw.randrange(4))) for _ in range(2500)] + [("equal", 2.5)] * 1500
    found += [("rising", float(k)) for k in range(1001)] + [("short", v) for v in (3.0, -1.0, 2.0)] + [("one", 7.0)]
    found += [(None, draw.gauss(0, 1)) for _ in range(1200)] + [("none", None), ("wide", None)]
    draw.shuffle(found)
    return found


def test_brackets_equal_sorting(spark, rows):
    frame = spark.createDataFrame(rows, "asset string, ret double").repartition(7)
    found = {r["asset"]: r for r in quantiles.selected(frame, "asset", "ret", SHARES, accuracy=100, whole=200).collect()}
    assert set(found) == {k for k, _ in rows}
    for key, got in found.items():
        values = [v for k, v in rows if k == key and v is not None]
        for name, share in SHARES.items():
            if values:
                assert math.isclose(got[name], np.quantile(values, share), rel_tol=1e-12, abs_tol=1e-12), (key, name)
            else:
                assert got[name] is None


def test_both_ways_are_alike(spark, rows, tmp_path, monkeypatch):
    spark.createDataFrame(rows, "asset string, ret double").write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    assert 0 < quantiles.plan_bytes(frame) < quantiles.BUFFERED_BYTES
    assert quantiles.plan_bytes(frame.join(frame.groupBy("asset").count(), "asset")) < quantiles.BUFFERED_BYTES
    from pyspark.sql import functions as F

    extra = F.count("*").alias("n"), F.max("ret").alias("greatest")
    near = sorted(quantiles.aggregated(frame, "asset", "ret", SHARES, *extra).collect(), key=repr)
    monkeypatch.setattr(quantiles, "BUFFERED_BYTES", -1)
    far = quantiles.aggregated(frame, "asset", "ret", SHARES, *extra)
    assert sorted(far.select("asset", *SHARES, "n", "greatest").collect(), key=repr) == near


def test_few_values_a_bracket(spark):
    """Of a long series only what lies in the brackets is grouped by value."""
    frame = spark.range(400_000).selectExpr("'a' AS asset", "CAST((id * 7919) % 400000 AS DOUBLE) AS ret")
    got = quantiles.selected(frame, "asset", "ret", {"q": 0.25}, accuracy=1000, whole=2000).collect()
    assert [tuple(x) for x in got] == [("a", 99_999.75)]


def test_edges(spark):
    empty = spark.createDataFrame([], "asset string, ret double")
    assert quantiles.selected(empty, "asset", "ret", SHARES).collect() == []
    with pytest.raises(ValueError):
        quantiles.selected(empty, "asset", "ret", SHARES, accuracy=100, whole=150)


def test_panel_without_losses(spark):
    import datetime

    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(4)]
    values = {"up": [1.0, 1.1, 1.3, 1.4], "once": [1.0, 1.1, 1.0, 1.4], "both": [1.0, 0.9, 1.2, 0.8]}
    prices = spark.createDataFrame([(d, k, p) for k, v in values.items() for d, p in zip(days, v, strict=True)], "date date, asset string, price double")
    from tidemark.operators.cleaning import simple_returns

    got = {r["asset"]: r for r in risk.panel(simple_returns(prices).select("date", "asset", "ret"), prices).collect()}
    assert got["up"]["sortino"] == got["once"]["sortino"] == math.inf and got["up"]["downside_vol"] == 0.0
    down = np.std([-0.1, 0.8 / 1.2 - 1], ddof=1) * math.sqrt(252)
    assert math.isclose(got["both"]["downside_vol"], down) and math.isclose(got["both"]["max_drawdown"], 0.8 / 1.2 - 1)
