"""Moments of all pairs of assets without joining the panel to itself.

Of few assets a date's returns are one list, whose pairs (a bounded number) are summed at once. Many are cut into blocks: a date's returns
of a block are one row, copied to the tasks (block, block, stripe of dates) that need it, and a task adds up products of
whole matrices of dates by assets, with masks for returns that are missing. What is shuffled grows with dates times
assets times blocks, not with dates times pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Assets up to which a date's pairs are listed; assets a block; stripes of dates; dates that a task multiplies at once.
FEW, BLOCK, STRIPES, DATES = 16, 256, 16, 256
KEY = ["low", "high", "stripe"]
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
PARTS = "i int, j int, " + ", ".join(f"{c} double" for c in SUMS)


def _products(batches: Iterator[pa.RecordBatch], n_assets: int, block: int) -> Iterator[pa.RecordBatch]:
    """The sums of each task's pairs, from rows that come by key and date."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEY, "date", "block")]
            cells = batch.column("cells")
            for k, own in enumerate(zip(*columns, strict=True)):
                yield *own, cells[k].values

    def width(b: int) -> int:
        return min(block, n_assets - b * block)

    for (low, high, _), own in groupby(rows(), key=lambda r: r[:3]):
        sums = np.zeros((6, width(low), width(high)))
        held = {b: np.full((DATES, width(b)), np.nan) for b in {low, high}}
        filled = 0

        def add(held: dict = held, sums: np.ndarray = sums, low: int = low, high: int = high) -> None:
            x, y = held[low], held[high]
            mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            sums += np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])
            for m in held.values():
                m.fill(np.nan)

        for _, same in groupby(own, key=lambda r: r[3]):
            for *_, b, cells in same:
                held[b][filled, cells.field(0).to_numpy()] = cells.field(1).to_numpy()
            filled += 1
            if filled == DATES:
                add()
                filled = 0
        add()
        i, j = np.nonzero(sums[0])
        at = (i + low * block, j + high * block)
        half = at[0] <= at[1]
        columns = [pa.array(x[half].astype(np.int32)) for x in at] + [pa.array(s[i, j][half]) for s in sums]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *SUMS])


def _tiled(returns: DataFrame, means: dict[str, float], block: int, stripes: int) -> DataFrame:
    names = sorted(means)
    n_assets, n_blocks = len(names), -(-len(names) // block)
    places = returns.sparkSession.createDataFrame([(k, i // block, i % block, means[k]) for i, k in enumerate(names)], "asset string, block int, pos int, mean double")
    placed = returns.filter("ret IS NOT NULL").join(F.broadcast(places), "asset")  # a row an asset
    vectors = placed.groupBy("date", "block").agg(F.collect_list(F.struct("pos", (F.col("ret") - F.col("mean")).alias("x"))).alias("cells"))
    copies = vectors.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    copies = copies.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "stripe": F.pmod(F.xxhash64("date"), F.lit(stripes)).cast("int")}).drop("other")
    dealt = copies.repartition(*KEY).sortWithinPartitions(*KEY, "date", "block").select(*KEY, "date", "block", "cells")
    summed = dealt.mapInArrow(lambda batches: _products(batches, n_assets, block), PARTS).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in SUMS))
    cov = F.when(F.col("n") > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1))
    spread = [F.greatest(F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / F.col("n"), F.lit(0.0)) for c in "xy"]
    correlation = F.when(F.col("n") > 1, F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(spread[0] * spread[1])))
    ends = places.select((F.col("block") * block + F.col("pos")).alias("i"), F.col("asset").alias("asset_i"))
    named = summed.join(F.broadcast(ends), "i").join(F.broadcast(ends.select(F.col("i").alias("j"), F.col("asset_i").alias("asset_j"))), "j")
    return named.select("asset_i", "asset_j", correlation.alias("correlation"), cov.alias("cov"))


def _listed(returns: DataFrame) -> DataFrame:
    rows = returns.filter("ret IS NOT NULL").groupBy("date").agg(F.array_sort(F.collect_list(F.struct("asset", "ret"))).alias("own"))
    first = rows.select("own", F.posexplode("own").alias("at", "a"))
    pairs = first.select("a", F.explode(F.slice("own", F.col("at") + 1, F.size("own") - F.col("at"))).alias("b"))
    values = pairs.select(F.col("a.asset").alias("asset_i"), F.col("b.asset").alias("asset_j"), F.col("a.ret").alias("x"), F.col("b.ret").alias("y"))
    sums = values.groupBy("asset_i", "asset_j").agg(F.covar_samp("x", "y").alias("cov"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    return sums.select("asset_i", "asset_j", F.try_divide("cov", F.sqrt(F.col("vx") * F.col("vy"))).alias("correlation"), "cov")


def means_of(returns: DataFrame) -> dict[str, float]:
    """Each asset's mean return, on the driver: a number an asset."""
    return {r["asset"]: r["mean"] for r in returns.groupBy("asset").agg(F.avg("ret").alias("mean")).collect() if r["mean"] is not None}


def pair_stats(returns: DataFrame, few: int = FEW, block: int = BLOCK, stripes: int = STRIPES, means: dict[str, float] | None = None) -> DataFrame:
    """asset_i, asset_j, correlation and cov (daily) of every ordered pair over dates that both have; pairs without such
    a date have no row, with one only no values, and with a series that doesn't move no correlation. A date and asset have
    one row at most. means, if known, spare a job."""
    means = means_of(returns) if means is None else means
    if not means:
        return returns.sparkSession.createDataFrame([], "asset_i string, asset_j string, correlation double, cov double")
    half = _listed(returns) if len(means) <= few else _tiled(returns, means, block, stripes)
    both = F.array(F.struct("asset_i", "asset_j"), F.struct(F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j")))
    turned = F.when(F.col("asset_i") < F.col("asset_j"), both).otherwise(F.slice(both, 1, 1))
    return half.select(F.explode(turned).alias("pair"), "correlation", "cov").select("pair.asset_i", "pair.asset_j", "correlation", "cov")
