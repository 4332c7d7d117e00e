"""Mixing sources to target weights: how often each document is repeated so that sources reach their shares.

All steps are DataFrame functions. Documents are read for their sizes; one row for each source is then planned
and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, scratch, small

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from md5 of seed and key; a null key counts as the word null."""
    digest = F.md5(F.concat_ws("-", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, weights: list[float], total_share: float, most: float) -> DataFrame:
    """One row for each source: source, source_size, target.

    Sources in ascending code-point order, null last, take the weights in turn. Together they take total_share of
    all sizes; none takes more than most times its size. What a capped source leaves is shared by weight among the
    rest: with sources in order of cap/weight, the first k are capped for the least k such that the others' share
    for a unit of weight, (total - caps of the first k) / (weights of the others), isn't above the next one's ratio.
    The windows run over one row a source, not over documents, in one task: a mix names its sources, so they are at most
    some hundred thousand rows of five numbers."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    turn = F.array(*map(F.lit, map(float, weights)))
    planned = by_source.withColumn("weight", F.element_at(turn, (F.row_number().over(order) - 1) % len(weights) + 1))
    planned = planned.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = W.partitionBy()
    rising = W.orderBy("ratio", F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    planned = (
        planned.withColumn("total", F.lit(total_share) * F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
        .withColumn("rank", F.row_number().over(rising))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(every)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return planned.select("source", "source_size", F.round(target, 6).alias("target"))


#: What mix() says of each document.
ADDED = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), total_share: float = 1.5, most: float = 2.0, seed: str = "mix", added: str = "mix") -> DataFrame:
    """docs, all columns as they are, with a struct column, added, of size, source_size, target and copies.

    A document's rate is target / source_size; it is taken floor(rate) times, and once more where a uniform number
    hashed from seed and doc_id is under the rate's fraction. Null text has size 0; a null source is a source;
    rows that repeat a doc_id draw the same number; a source of size 0 has rate 0; no documents give no rows. Other
    columns may have any names but added's."""
    text, source = docs["text"], docs["source"]
    plan = scratch(source_targets(docs.select(source, word_count(text).alias("size")), list(weights), total_share, most), "mix")
    plan = small(plan.select(F.col("source").alias("key"), "source_size", "target"), 200)
    names = [f"c{k}" for k in range(len(docs.columns))]
    own = docs.select(*docs.columns, word_count(text)).toDF(*names, "size")
    key, ident = (F.col(names[docs.columns.index(c)]) for c in ("source", "doc_id"))
    rate = F.coalesce(F.try_divide("target", F.col("source_size")), F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(uniform(ident, seed) < rate - whole, 1).otherwise(0)
    mixed = own.join(plan, key.eqNullSafe(F.col("key"))).withColumn("copies", copies.cast("long"))
    return mixed.select(*names, F.struct(*ADDED)).toDF(*docs.columns, added)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """Each row of docs as often as mix() takes it, all columns as they are."""
    name = free_name(docs, "mix")
    rows = mix(docs, added=name, **options).filter(F.col(name)["copies"] > 0)
    copy = free_name(rows, "copy")
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int")))).select(*docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    taken = F.col("mix.size") * F.col("mix.copies")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", taken.alias("taken"), "mix.copies")


#: Reshares step by step: each round caps the sources whose share is above their cap and deals the rest anew.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS weight
  FROM d GROUP BY source
), r(round, source, source_size, weight, capped) AS (
  SELECT 0, source, source_size, weight, false FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         capped OR weight * (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (capped) OVER (), 0))
                   / nullif(sum(weight) FILTER (NOT capped) OVER (), 0) > 2.0 * source_size
  FROM r WHERE round < (SELECT count(*) FROM s)
), e AS (SELECT * FROM r WHERE round = (SELECT count(*) FROM s)),
t AS (
  SELECT source, source_size,
         round(CASE WHEN capped THEN 2.0 * source_size
                    ELSE weight * (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (capped) OVER (), 0))
                         / sum(weight) FILTER (NOT capped) OVER () END, 6) AS target
  FROM e
), c AS (
  SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate,
         CAST('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, size * copies AS taken, copies FROM k
"""
