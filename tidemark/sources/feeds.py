"""Payloads of price and macro services as panels. Fetching is the caller's: these take what a service has sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_rows(rows: DataFrame, assets: list[str], share: float = 0.5) -> DataFrame | None:
    """date, asset, price from rows of (symbol, date, close); None if under share of the assets are there."""
    panel = rows.select(F.to_date("date").alias("date"), F.col("symbol").alias("asset"), F.col("close").cast("double").alias("price")).filter(F.col("asset").isin(assets))
    return panel if panel.agg(F.countDistinct("asset")).first()[0] >= share * len(assets) else None


def index_rows(rows: DataFrame) -> DataFrame:
    """date, factor, value of the symbols that start with a caret, which is taken off."""
    carets = rows.filter(F.col("symbol").startswith("^"))
    return carets.select(F.to_date("date").alias("date"), F.regexp_replace("symbol", r"\^", "").alias("factor"), F.col("close").cast("double").alias("value"))


def daily_series(payloads: DataFrame, start: str, end: str) -> DataFrame:
    """date, asset, price from (symbol, payload): JSON of days by date, each with "4. close"; both ends count."""
    days = F.from_json(F.get_json_object("payload", "$['Time Series (Daily)']"), "map<string, map<string, string>>")
    rows = payloads.select("symbol", F.explode(days).alias("day", "values"))
    panel = rows.select(F.to_date("day").alias("date"), F.col("symbol").alias("asset"), F.col("values")["4. close"].cast("double").alias("price"))
    return panel.filter(F.col("date").between(start, end))


def aggregates(payloads: DataFrame) -> DataFrame:
    """date, asset, price from (symbol, payload): JSON with results of t (milliseconds since 1970) and c."""
    rows = payloads.select("symbol", F.explode(F.from_json(F.get_json_object("payload", "$.results"), "array<struct<t: bigint, c: double>>")).alias("bar"))
    return rows.select(F.to_date(F.timestamp_millis("bar.t")).alias("date"), F.col("symbol").alias("asset"), F.col("bar.c").alias("price"))


def observations(rows: DataFrame) -> DataFrame:
    """date, factor, value from rows of (series, date, value), where a full stop stands for no value."""
    value = F.expr("try_cast(value AS DOUBLE)")
    return rows.select(F.to_date("date").alias("date"), F.col("series").alias("factor"), value.alias("value"))
