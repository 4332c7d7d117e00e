"""Calendar alignment, filling, interpolation, returns and outliers of long panels.

Windows are partitioned by series. A series is named by `key` (asset or factor), its measure by `value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import quantiles
from ..sources.files import staged


def series(key: str = "asset", date: str = "date") -> W:
    return W.partitionBy(key).orderBy(date)


def scaffold(panel: DataFrame, key: str = "asset", value: str = "price", date: str = "date") -> DataFrame:
    """Every series at every date of the panel, null where it has no value. The series' names travel as one array."""
    names = panel.agg(F.array_sort(F.collect_set(key)).alias("_names"))
    dates = panel.select(date).distinct().crossJoin(F.broadcast(names))  # one row
    cells = dates.select(date, F.explode("_names").alias(key))
    return cells.join(panel.select(date, key, value), [date, key], "left")


def missing(cells: DataFrame, key: str = "asset", value: str = "price") -> DataFrame:
    share = F.avg(F.when(F.col(value).isNull(), 100.0).otherwise(0.0))
    return cells.groupBy(key).agg(F.count("*").alias("n_dates"), F.count_if(F.col(value).isNull()).alias("n_missing"), share.alias("missing_pct"))


def keep_covered(cells: DataFrame, most: float = config.MAX_MISSING_PCT, key: str = "asset", value: str = "price") -> DataFrame:
    """Series with less than most per cent missing; an error if none is left."""
    good = missing(cells, key, value).filter(F.col("missing_pct") < most).select(key)
    kept = cells.join(good, key, "left_semi")
    if good.isEmpty():
        raise ValueError(f"every series misses at least {most} % of its values")
    return kept


def filled(value: Column, w) -> Column:
    """The last value so far, else the first to come."""
    back = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.coalesce(back, F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing)))


def fill(cells: DataFrame, key: str = "asset", value: str = "price", date: str = "date") -> DataFrame:
    return cells.withColumn(value, filled(F.col(value), series(key, date)))


def complete_dates(cells: DataFrame, value: str = "price", date: str = "date") -> DataFrame:
    """Only dates at which no series is null."""
    holes = cells.groupBy(date).agg(F.count_if(F.col(value).isNull()).alias("_holes")).filter("_holes = 0").select(date)
    return cells.join(holes, date, "left_semi")


def simple_returns(panel: DataFrame, key: str = "asset", value: str = "price", date: str = "date", name: str = "ret") -> DataFrame:
    """The change over the row before, as a share; first rows go."""
    change = F.try_divide(F.col(value), F.lag(value).over(series(key, date))) - 1
    return panel.withColumn(name, change).filter(F.col(name).isNotNull())


def rolling_z(returns: DataFrame, rows: int = 20, least: int = 5) -> DataFrame:
    """returns with z, over the last rows including this one; null under least values or without spread."""
    w = series().rowsBetween(1 - rows, 0)
    std = F.nullif(F.stddev_samp("ret").over(w), F.lit(0.0))
    z = F.try_divide(F.col("ret") - F.avg("ret").over(w), std)
    return returns.withColumn("z", F.when(F.count("ret").over(w) >= least, z))


def winsorized(returns: DataFrame, threshold: float = config.OUTLIER_THRESHOLD, tail: float = 0.005) -> DataFrame:
    """returns with ret clipped to its series' tail quantiles if any series has a rolling |z| above threshold."""
    fires = rolling_z(returns).agg(F.coalesce(F.max(F.abs("z")) > threshold, F.lit(False)).alias("_fires"))
    bounds = quantiles.aggregated(returns, "asset", "ret", {"_low": tail, "_high": 1 - tail})
    clipped = F.greatest(F.least("ret", "_high"), "_low")
    joined = returns.join(bounds, "asset").crossJoin(F.broadcast(fires))  # one row
    return joined.withColumn("ret", F.when(F.col("_fires"), clipped).otherwise(F.col("ret"))).drop("_low", "_high", "_fires")


def rebuilt(panel: DataFrame, returns: DataFrame) -> DataFrame:
    """Prices from first prices and returns; the first date keeps its price."""
    w = series()
    first = panel.groupBy("asset").agg(F.min_by("price", "date").alias("_p0"), F.min("date").alias("_d0"))
    grown = returns.join(first, "asset").withColumn("price", F.col("_p0") * F.product(1 + F.col("ret")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grown.select("date", "asset", "price").unionByName(first.select(F.col("_d0").alias("date"), "asset", F.col("_p0").alias("price")))


def business_days(panel: DataFrame, key: str = "asset", value: str = "price") -> DataFrame:
    """Every Monday to Friday between each panel's first and last date; weekend rows go, gaps are filled forwards."""
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.collect_set(key).alias("_names"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"), "_names").filter(F.weekday("date") < 5)
    cells = days.select("date", F.explode("_names").alias(key)).join(panel.select("date", key, value), ["date", key], "left")
    last = F.last(value, True).over(series(key).rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumn(value, last)


def month_ends(panel: DataFrame, key: str = "asset", value: str = "price") -> DataFrame:
    """The last value of each calendar month, dated by the month's last day."""
    return panel.groupBy(key, F.last_day("date").alias("date")).agg(F.max_by(value, "date").alias(value))


def interpolated(cells: DataFrame, key: str = "factor", value: str = "value", date: str = "date", by_time: bool = True) -> DataFrame:
    """Null cells on the line between their neighbours, by elapsed days or, with by_time false, by row; values after
    the last stay at it, values before the first take it."""
    w = series(key, date)
    x = F.datediff(F.col(date), F.lit("1970-01-01")) if by_time else F.row_number().over(w)
    at = cells.withColumn("_x", x)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_x").alias("x"), F.col(value).alias("v")))
    before = F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing))
    at = at.withColumns({"_a": before, "_b": after})
    slope = F.try_divide(F.col("_b.v") - F.col("_a.v"), (F.col("_b.x") - F.col("_a.x")).cast("double"))
    line = F.col("_a.v") + slope * (F.col("_x") - F.col("_a.x"))
    return at.withColumn(value, F.coalesce(value, line, F.col("_a.v"), F.col("_b.v"))).drop("_x", "_a", "_b")


def to_business_days(panel: DataFrame, key: str = "factor", value: str = "value") -> DataFrame:
    """Upsampled to Monday to Friday and interpolated by time; observations on other days are left out first."""
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.collect_set(key).alias("_names"))
    days = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"), "_names").filter(F.weekday("date") < 5)
    cells = days.select("date", F.explode("_names").alias(key)).join(panel.select("date", key, value), ["date", key], "left")
    return interpolated(cells, key, value)


def concat_first(*panels: DataFrame, key: str = "factor") -> DataFrame:
    """The union of panels; where several have a cell, the first panel's stays."""
    tagged = [p.withColumn("_source", F.lit(i)) for i, p in enumerate(panels)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other)
    first = F.row_number().over(W.partitionBy("date", key).orderBy("_source"))
    return union.withColumn("_first", first).filter("_first = 1").drop("_first", "_source")


def macro_changes(panel: DataFrame, levels: tuple[str, ...] = config.LEVEL_FACTORS, most_null: float = 0.3) -> DataFrame:
    """date, factor (named with its kind of change) and change: a difference for level factors, else per cent. Factors
    with more than most_null nulls are skipped; dates at which any change is null go."""
    good = panel.groupBy("factor").agg(F.avg(F.col("value").isNull().cast("double")).alias("_nulls")).filter(F.col("_nulls") <= most_null).select("factor")
    lag = F.lag("value").over(series("factor"))
    level = F.col("factor").isin(*levels)
    change = F.when(level, F.col("value") - lag).otherwise((F.try_divide(F.col("value"), lag) - 1) * 100)
    named = F.concat("factor", F.when(level, F.lit("_change")).otherwise(F.lit("_pct_change")))
    changed = panel.join(good, "factor", "left_semi").select("date", named.alias("factor"), change.alias("change"))
    return complete_dates(changed, "change")


def clean_prices(panel: DataFrame) -> DataFrame:
    """The whole sequence for prices: coverage, filling, outliers, business days. The filled cells, a row a series and
    date, are staged in a file, as outliers and the rebuilding read them again."""
    cells = staged(complete_dates(fill(keep_covered(scaffold(staged(panel, "panel"))))), "cells")
    return business_days(rebuilt(cells, winsorized(simple_returns(cells))))
