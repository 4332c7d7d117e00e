"""Panels, records and weights in files: wide and long CSV, JSON, Parquet; the newest of several; fallbacks; a cache."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import long, wide


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def require(spark: SparkSession, *paths: str) -> None:
    """An error that names the first path that isn't there."""
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)


def read_wide_csv(spark: SparkSession, path: str, key: str = "asset", value: str = "price") -> DataFrame:
    """date, key, value from a file with a date index first, named or not, and a column for each series."""
    frame = spark.read.option("header", True).csv(path)
    index, *names = frame.columns
    typed = frame.select(F.to_date(F.substring(F.col(f"`{index}`"), 1, 10)).alias("date"), *(F.expr(f"try_cast(`{n}` AS DOUBLE)").alias(n) for n in names))
    return long(typed, key, value)


def write_wide_csv(panel: DataFrame, path: str, names: list[str] | None = None, key: str = "asset", value: str = "price") -> None:
    """A column for each series; overwrites."""
    wide(panel, names, key, value).orderBy("date").write.mode("overwrite").option("header", True).csv(path)


def read_records(spark: SparkSession, path: str, pattern: str, name: str = "name", multiline: bool = True) -> DataFrame:
    """All JSON documents that a glob finds (a file each, or a line each), with the part of the path that the pattern's
    group holds."""
    frame = spark.read.option("multiLine", multiline).json(path)
    return frame.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_tagged_csv(spark: SparkSession, path: str, schema: str, pattern: str, name: str = "name") -> DataFrame:
    """All CSV files that a glob finds, with the part of the path that the pattern's group holds."""
    return spark.read.option("header", True).schema(schema).csv(path).withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def listed(spark: SparkSession, pattern: str) -> list[tuple[int, int, str]]:
    """(time of change, bytes, path) of the data files that a glob finds, itself or in the folders that it finds: the file
    system's listing, no file is opened."""
    fs, at = _fs(spark, pattern)
    found = []
    for status in fs.globStatus(at) or []:
        files = fs.listFiles(status.getPath(), True)  # of a file, the file
        while files.hasNext():
            one = files.next()
            if not one.getPath().getName().startswith(("_", ".")):
                found.append((one.getModificationTime(), one.getLen(), one.getPath().toString()))
    return found


def newest(spark: SparkSession, pattern: str) -> str:
    """The path of the file that was changed last (of equals, the last name)."""
    found = listed(spark, pattern)
    if not found:
        raise FileNotFoundError(pattern)
    return max((changed, path) for changed, _, path in found)[1]


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def first_with_rows(readers: list[tuple[str, Callable[[], DataFrame]]], names: list[str], share: float = 0.5, key: str = "asset") -> tuple[str, DataFrame]:
    """The name and panel of the first reader that has at least share of the names of key (asset or factor); readers that
    fail are passed over. A synthetic panel as the last reader makes a chain that always ends."""
    errors = []
    for name, reader in readers:
        try:
            panel = reader()
            found = panel.filter(F.col(key).isin(names)).agg(F.countDistinct(key)).first()[0]
        except (PySparkException, Py4JError, OSError) as error:  # a source that can't be reached is what the chain is for
            errors.append(f"{name}: {error}")
            continue
        if found and found >= share * len(names):
            return name, panel
    raise ValueError(f"no source has {share:.0%} of the names; {'; '.join(errors)}")


def each_factor(readers: list[tuple[str, Callable[[str], DataFrame]]], factors: list[str]) -> DataFrame:
    """date, factor, value, source: each factor from the first reader that has rows of it; factors without are left out."""
    found = []
    for factor in factors:
        try:
            name, panel = first_with_rows([(n, lambda r=r: r(factor)) for n, r in readers], [factor], 1.0, "factor")
        except ValueError:
            continue
        found.append(panel.filter(F.col("factor") == factor).select("date", "factor", "value", F.lit(name).alias("source")))
    if not found:
        raise ValueError(f"no source has any of {factors}")
    return reduce(DataFrame.unionByName, found)


_made: set[str] = set()


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir, which a cluster must name; one
    process alone may use its warehouse), in a part that goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    root = f"{base}/tidemark-files-{spark.sparkContext.applicationId}"
    if root not in _made:
        fs, at = _fs(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _made.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def staged(frame: DataFrame, name: str) -> DataFrame:
    """frame, written to a workspace and read again: for what several branches of a plan read. Nothing stays in the
    executors' memory."""
    path = workspace(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def collection_metadata(panel: DataFrame, macro: DataFrame, requested: list[str], source: str) -> DataFrame:
    """One row: rows, series, dates, which source gave them, and the assets that are missing."""
    prices = panel.agg(F.count("*").alias("n_prices"), F.collect_set("asset").alias("_assets"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    factors = macro.agg(F.count("*").alias("n_macro"), F.array_sort(F.collect_set("factor")).alias("factors"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, requested)), "_assets"))
    return prices.crossJoin(factors).select("n_prices", F.size("_assets").alias("n_assets"), "first_date", "last_date", "n_macro", "factors", missing.alias("missing"), F.lit(source).alias("source"))  # one row each


def cached(spark: SparkSession, path: str, parameters: dict, inputs: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows, kept at path under the hash of all parameters and of the inputs' rows, so that new data is never
    met by an old result."""
    columns = sorted(inputs.columns)
    mark = inputs.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
    name = hashlib.sha256(json.dumps([parameters, str(mark[0]), str(mark[1])], sort_keys=True, default=str).encode()).hexdigest()[:24]
    at = f"{path}/{name}"
    if not exists(spark, f"{at}/_SUCCESS"):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and time of change of the files that a glob finds, by the file system's listing."""
    rows = [(at.rsplit("/", 1)[1], size, changed / 1000) for changed, size, at in listed(spark, path)]
    return spark.createDataFrame(rows, "name string, bytes long, changed double").withColumn("changed", F.timestamp_seconds("changed"))
