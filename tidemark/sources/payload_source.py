"""Folders of service payloads as a Spark data source: spark.read.format("payloads").load(path).

A folder holds asset=<symbol> folders of text files, each line one JSON document of a service (daily series by date, or
bars by milliseconds). Documents of one symbol are any number of files. Symbols and dates that a query asks for reach the
source: folders of other symbols aren't opened, rows of other dates aren't made. Files are dealt to partitions by size."""

from __future__ import annotations

import datetime
import io
import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import IO
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of files that a partition reads, at least one file.
PARTITION_BYTES = 32 << 20
SCHEMA = "date date, asset string, price double"


@dataclass
class Files(InputPartition):
    names: list[tuple[str, str]]  # symbol, path


def days_of(document: dict) -> Iterator[tuple[datetime.date, float]]:
    """The days of either kind of document; days without a close are left out."""
    for day, values in (document.get("Time Series (Daily)") or {}).items():
        if (close := values.get("4. close")) is not None:
            yield datetime.date.fromisoformat(day[:10]), float(close)
    for bar in document.get("results") or []:
        if bar.get("c") is not None:
            yield datetime.datetime.fromtimestamp(bar["t"] / 1000, datetime.UTC).date(), float(bar["c"])


def local(path: str) -> str | None:
    """The path on this machine's file system (mounted on all, if it is a cluster's); None for another store."""
    if path.startswith("file:"):
        return unquote(urlsplit(path).path)
    return None if "://" in path else path


def listing(path: str) -> Iterator[tuple[str, int]]:
    """Path and bytes of each file below a folder."""
    if (base := local(path)) is not None:
        for folder, _, names in os.walk(base):
            yield from ((f"{folder}/{name}", os.path.getsize(f"{folder}/{name}")) for name in names)
        return
    from pyarrow import fs  # another store: only then are its clients loaded

    store, base = fs.FileSystem.from_uri(path)
    for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
        if info.type == fs.FileType.File:
            yield info.path, info.size


def opened(base: str, path: str) -> IO[str]:
    if local(base) is not None:
        return open(path, encoding="utf-8")
    from pyarrow import fs

    return io.TextIOWrapper(fs.FileSystem.from_uri(base)[0].open_input_stream(path), encoding="utf-8")


class PayloadReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.assets: set[str] | None = None
        self.first, self.last = datetime.date.min, datetime.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and membership of asset, and bounds of date; hands the others back."""
        day = datetime.timedelta(days=1)
        for own in filters:
            name = getattr(own, "attribute", None)
            if name == ("asset",) and isinstance(own, EqualTo | In):
                asked = {own.value} if isinstance(own, EqualTo) else set(own.value)
                self.assets = asked if self.assets is None else self.assets & asked
            elif name == ("date",) and isinstance(own, GreaterThanOrEqual | GreaterThan):
                self.first = max(self.first, own.value + (day if isinstance(own, GreaterThan) else 0 * day))
            elif name == ("date",) and isinstance(own, LessThanOrEqual | LessThan):
                self.last = min(self.last, own.value - (day if isinstance(own, LessThan) else 0 * day))
            else:
                yield own

    def partitions(self) -> list[InputPartition]:
        found: list[list[tuple[str, str]]] = []
        held = PARTITION_BYTES
        for path, size in sorted(listing(self.path)):
            folder, _, name = path.rpartition("/")
            symbol = unquote(folder.rpartition("/")[2].partition("asset=")[2])
            if name.startswith(("_", ".")) or (self.assets is not None and symbol not in self.assets):
                continue
            if held >= PARTITION_BYTES:
                found.append([])
                held = 0
            found[-1].append((symbol, path))
            held += size
        return [Files(names) for names in found] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for symbol, path in partition.names:
            with opened(self.path, path) as stream:
                for line in stream:
                    rows = [r for r in days_of(json.loads(line)) if self.first <= r[0] <= self.last] if line.strip() else []
                    columns = [pa.array([r[0] for r in rows], pa.date32()), pa.array([symbol] * len(rows), pa.string()), pa.array([r[1] for r in rows], pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["date", "asset", "price"])


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PayloadSource)
