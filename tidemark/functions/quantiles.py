"""Exact quantiles by series, interpolated between neighbouring ranks, for series of any length.

The built-in percentile keeps a group's distinct values in one buffer, which suits inputs of some hundred megabytes. Beyond,
a sketch with a proven error of rank brackets each quantile, rows below a bracket are only counted, and what lies inside it,
some 8 rows in 100,000, is sorted within series and quantile by a sort that may spill. Both ways give the same numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Plans that read more than this, or an unknown number of bytes, take the second way.
BUFFERED_BYTES = 256 << 20
#: The sketch's error is one in ACCURACY of the rows of a series; series of at most WHOLE values are sorted as they are.
ACCURACY, WHOLE = 100_000, 200_000


def plan_bytes(frame: DataFrame) -> int:
    """The bytes of what a plan reads, by the optimizer's statistics (its estimate for a join is a product, so only leaves
    are summed); no job runs."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def aggregated(frame: DataFrame, key: str, value: str, shares: dict[str, float], *others: Column) -> DataFrame:
    """key, a column for each name of shares with that quantile of value, and the aggregates of others. Nulls are left out,
    a series without values has null quantiles, a null key is a series."""
    if plan_bytes(frame) <= BUFFERED_BYTES:
        return frame.groupBy(key).agg(*(F.percentile(value, F.lit(s)).alias(n) for n, s in shares.items()), *others)
    found = selected(frame, key, value, shares)
    if not others:
        return found
    rest = frame.groupBy(F.col(key).alias("_key")).agg(*others)
    return found.join(rest, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def selected(frame: DataFrame, key: str, value: str, shares: dict[str, float], accuracy: int = ACCURACY, whole: int = WHOLE) -> DataFrame:
    """key and the quantiles of aggregated(), by brackets. whole must be at least twice accuracy: then a margin of three
    errors on both sides holds the neighbouring ranks for certain."""
    if whole < 2 * accuracy:
        raise ValueError("whole must be at least twice accuracy")
    rows = frame.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    ends = [min(max(s + side * 3 / accuracy, 0.0), 1.0) for s in shares.values() for side in (-1, 1)]
    sized = rows.groupBy("_key").agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.approx_percentile("_v", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("_ends")
    )
    long = F.col("_n") > whole

    def bracket(i: int, name: str, share: float) -> Column:
        low = F.when(long & F.lit(share > 3 / accuracy), F.col("_ends")[2 * i]).otherwise(F.col("_least"))
        high = F.when(long & F.lit(share < 1 - 3 / accuracy), F.col("_ends")[2 * i + 1]).otherwise(F.col("_most"))
        return F.struct(F.lit(name).alias("_name"), low.alias("_low"), high.alias("_high"), ((F.col("_n") - 1) * F.lit(share)).alias("_at"))

    brackets = sized.select("_key", F.inline(F.array(*(bracket(i, n, s) for i, (n, s) in enumerate(shares.items())))))
    named = brackets.withColumnRenamed("_key", "_own")
    inside = rows.filter("_v IS NOT NULL").join(named, F.col("_key").eqNullSafe(F.col("_own")) & (F.col("_v") <= F.col("_high")))
    # rows below a bracket fold into one row with no value
    cells = inside.groupBy("_own", "_name", "_at", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("_own", "_name").orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0))
    below, above = F.floor("_at"), F.ceil("_at")
    ranks = cells.withColumn("_upto", upto).groupBy("_own", "_name", "_at").agg(
        F.min(F.when(F.col("_upto") > below, F.col("_v"))).alias("_a"), F.min(F.when(F.col("_upto") > above, F.col("_v"))).alias("_b")
    )
    between = (above - F.col("_at")) * F.col("_a") + (F.col("_at") - below) * F.col("_b")
    result = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between)
    wide = ranks.withColumn("_q", result).groupBy("_own").agg(*(F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in shares))
    return sized.select("_key").join(wide, F.col("_key").eqNullSafe(F.col("_own")), "left").select(F.col("_key").alias(key), *shares)
