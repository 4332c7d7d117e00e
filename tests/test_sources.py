import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds, files, payload_source, synthetic


def test_wide_csv_round_trip(spark, tmp_path):
    rows = [("2021-01-04", "a", 1.0), ("2021-01-04", "b", 2.0), ("2021-01-05", "a", 3.5)]
    panel = spark.createDataFrame(rows, "date string, asset string, price double").withColumn("date", F.to_date("date"))
    files.write_wide_csv(panel, f"{tmp_path}/wide")
    back = files.read_wide_csv(spark, f"{tmp_path}/wide")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, panel.collect()))
    (tmp_path / "index.csv").write_text(",x\n2021-01-04 04:00:00,1.5\n2021-01-05 05:00:00,\n")
    assert [(str(r["date"]), r["asset"], r["price"]) for r in files.read_wide_csv(spark, f"{tmp_path}/index.csv").collect()] == [("2021-01-04", "x", 1.5)]


def test_names_of_files_and_the_newest(spark, tmp_path):
    for name in ("mc_stats_b.json", "mc_stats_a.json"):
        (tmp_path / name).write_text(json.dumps({"mean": len(name), "of": name}))
        time.sleep(1.1)
    records = files.read_records(spark, f"{tmp_path}/mc_stats_*.json", r"mc_stats_(\w+)\.json", "method")
    assert sorted(r["method"] for r in records.collect()) == ["a", "b"]
    last = spark.read.option("multiLine", True).json(files.newest(spark, f"{tmp_path}/mc_stats_*.json"))
    assert [r["of"] for r in last.collect()] == ["mc_stats_a.json"] and len(last.inputFiles()) == 1
    with pytest.raises(FileNotFoundError):
        files.newest(spark, f"{tmp_path}/none*.json")
    assert files.catalogue(spark, f"{tmp_path}/*.json").count() == 2
    with pytest.raises(FileNotFoundError):
        files.require(spark, f"{tmp_path}/mc_stats_a.json", f"{tmp_path}/none.csv")


def test_fallbacks_and_cache(spark, tmp_path):
    some = spark.createDataFrame([("2021-01-04", "a", 1.0)], "date string, asset string, price double")

    def broken():
        raise OSError("unreachable")

    name, panel = files.first_with_rows([("broken", broken), ("empty", lambda: some.limit(0)), ("some", lambda: some)], ["a", "b"])
    assert name == "some" and panel.count() == 1
    with pytest.raises(ValueError):
        files.first_with_rows([("broken", broken)], ["a"])
    macro = spark.createDataFrame([("2021-01-04", "f", 1.0)], "date string, factor string, value double")
    assert files.collection_metadata(some, macro, ["a", "b"], "some").first()["missing"] == ["b"]
    built = []

    def build():
        built.append(1)
        return some

    for inputs in (some, some, some.withColumn("price", F.lit(2.0))):
        files.cached(spark, f"{tmp_path}/cache", {"seed": 1}, inputs, build)
    assert len(built) == 2


def test_service_payloads(spark):
    daily = json.dumps({"Time Series (Daily)": {"2021-01-04": {"4. close": "1.5"}, "2022-01-04": {"4. close": "9"}}})
    assert [(str(r["date"]), r["price"]) for r in feeds.daily_series(spark.createDataFrame([("a", daily)], "symbol string, payload string"), "2021-01-01", "2021-12-31").collect()] == [("2021-01-04", 1.5)]
    bars = json.dumps({"results": [{"t": 1609718400000, "c": 2.5}]})
    assert [(str(r["date"]), r["asset"], r["price"]) for r in feeds.aggregates(spark.createDataFrame([("b", bars)], "symbol string, payload string")).collect()] == [("2021-01-04", "b", 2.5)]
    rows = spark.createDataFrame([("^VIX", "2021-01-04", 20.0), ("SPY", "2021-01-04", 370.0)], "symbol string, date string, close double")
    assert [(r["factor"], r["value"]) for r in feeds.index_rows(rows).collect()] == [("VIX", 20.0)]
    assert feeds.history_rows(rows, ["SPY"]).count() == 1 and feeds.history_rows(rows, ["SPY", "A", "B"]) is None
    seen = feeds.observations(spark.createDataFrame([("CPI", "2021-01-01", "261.5"), ("CPI", "2021-02-01", ".")], "series string, date string, value string"))
    assert [r["value"] for r in seen.orderBy("date").collect()] == [261.5, None]


def test_synthetic_panels(spark):
    panel = synthetic.prices(spark, {"a": (100, 0.0005, 0.01), "b": (50, 0.0, 0.02)}, "2020-01-01", "2020-12-31")
    again = synthetic.prices(spark, {"b": (50, 0.0, 0.02), "a": (100, 0.0005, 0.01)}, "2020-01-01", "2020-12-31").repartition(3)
    rows = sorted(map(tuple, panel.collect()))
    assert rows == sorted(map(tuple, again.collect())) and len(rows) == 2 * 262 and all(r[2] > 0 for r in rows)
    macro = synthetic.macro(spark, {"rate": (0.1, -0.05, 0.2, True), "cpi": (250, 0.002, 0.001, False)}, "2020-01-01", "2021-12-31")
    by = {}
    for r in macro.orderBy("date").collect():
        by.setdefault(r["factor"], []).append(r["value"])
    assert min(by["rate"]) == 0.0 and len(set(by["cpi"])) == 24


def test_each_factor_comes_from_the_first_source_that_has_it(spark):
    rows = spark.createDataFrame([("2021-01-04", "a", 1.0), ("2021-01-04", "b", 2.0)], "date string, factor string, value double")

    def broken(factor):
        raise OSError("unreachable")

    readers = [("broken", broken), ("only a", lambda f: rows.filter("factor = 'a'")), ("all", lambda f: rows)]
    assert sorted((r["factor"], r["source"]) for r in files.each_factor(readers, ["a", "b", "c"]).collect()) == [("a", "only a"), ("b", "all")]
    with pytest.raises(ValueError):
        files.each_factor(readers, ["c"])


def test_payload_format(spark, tmp_path):
    base = tmp_path / "payloads"
    for folder, lines in (
        ("asset=A%20B", [json.dumps({"Time Series (Daily)": {"2021-01-04": {"4. close": "1.5"}, "2022-01-04": {"4. close": "9"}, "2022-01-05": {}}}), ""]),
        ("asset=C", [json.dumps({"results": [{"t": 1609718400000, "c": 2.5}, {"t": 1609718400000, "c": None}]}), json.dumps({})]),
        ("asset=D", ["not json"]),
    ):
        (base / folder).mkdir(parents=True)
        (base / folder / "part-0.txt").write_text("\n".join(lines))
    payload_source.register(spark)
    frame = spark.read.format("payloads").load(str(base))
    known = frame.filter(F.col("asset").isin("A B", "C"))  # the folder of D isn't opened
    assert sorted((str(r["date"]), r["asset"], r["price"]) for r in known.collect()) == [("2021-01-04", "A B", 1.5), ("2021-01-04", "C", 2.5), ("2022-01-04", "A B", 9.0)]
    later = spark.read.format("payloads").load(f"file://{base}").filter("asset = 'A B' AND date > DATE '2021-01-04' AND price > 1")
    assert [r["price"] for r in later.collect()] == [9.0]
    reader = payload_source.PayloadReader(str(base))
    left = list(reader.pushFilters([payload_source.EqualTo(("asset",), "C"), payload_source.GreaterThan(("price",), 1.0)]))
    assert [f.attribute for f in left] == [("price",)] and [p.names for p in reader.partitions()] == [[("C", f"{base}/asset=C/part-0.txt")]]
    assert frame.filter("asset = 'none'").count() == 0
