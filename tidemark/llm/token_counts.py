"""Token counts as rollups that deltas maintain.

A rollup is a folder of committed batches. Each batch holds signed sums by source, language and tokenizer version:
inserts add, deletes subtract, a revised count subtracts what was counted and adds what is. Totals are the sum of all
batches, so a batch costs its own rows only. A batch is written aside and committed by one rename to its own name;
committing a name again changes nothing, whether a driver was lost before or after the rename. One driver at a time
commits to a rollup, and the folder's file system must rename a folder in one step (HDFS and local disks do; over an
object store, keep the rollup in a table format with commits of its own)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, scratch_path, slices
from .tokens import ENCODE_BYTES, TOKENIZER, TokenCache

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class Rollup:
    """Totals at path, a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join([self.path, *names]))

    def _fold(self) -> tuple[str | None, set[str]]:
        """The newest fold, which holds all before it, and the names of its batches."""
        folds = sorted(self.names("folds"))
        if not folds:
            return None, set()
        return folds[-1], {r["name"] for r in self.spark.read.parquet(f"{self.path}/folds/{folds[-1]}/names").collect()}

    def names(self, kind: str) -> set[str]:
        at = self._at(kind)
        return {x.getPath().getName() for x in self._fs.listStatus(at)} if self._fs.exists(at) else set()

    def _publish(self, aside: str, kind: str, name: str) -> bool:
        """Whether the rename has made aside kind/name; if that name stands already, aside goes."""
        self._fs.mkdirs(self._at(kind))
        if not self._fs.exists(self._at(kind, name)) and self._fs.rename(self._at(aside), self._at(kind, name)):
            return True
        self._fs.delete(self._at(aside), True)
        return False

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds deltas (source, lang, tokenizer, n_docs, n_tokens; signed) under the name batch; False, and no change,
        if that name is committed already."""
        if batch in self.names("batches") or batch in self._fold()[1]:
            return False
        aside = f"aside-{uuid.uuid4().hex[:12]}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.parquet(f"{self.path}/{aside}")
        return self._publish(aside, "batches", batch)

    def totals(self) -> DataFrame:
        """Sums of all batches; keys whose documents are all gone have no row. Null source or language is a key; a
        rollup without batches has no rows."""
        fold, folded = self._fold()
        return self._sums(fold, self.names("batches") - folded)

    def _sums(self, fold: str | None, batches: set[str]) -> DataFrame:
        parts = [f"{self.path}/folds/{fold}/sums"] * (fold is not None) + [f"{self.path}/batches/{x}" for x in sorted(batches)]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs != 0 OR n_tokens != 0")

    def compact(self) -> None:
        """Folds the batches that stand now into one table with their names; batches that are committed meanwhile stay
        outside it. The batches, and the fold before, are deleted once the new one stands."""
        fold, folded = self._fold()
        batches = self.names("batches")
        fresh = batches - folded
        aside = f"aside-{uuid.uuid4().hex[:12]}"
        self._sums(fold, fresh).coalesce(1).write.parquet(f"{self.path}/{aside}/sums")
        self.spark.createDataFrame([(x,) for x in sorted(folded | fresh)], "name string").coalesce(1).write.parquet(f"{self.path}/{aside}/names")
        if self._publish(aside, "folds", f"{int(fold or -1) + 1:08d}"):
            for name in batches:
                self._fs.delete(self._at("batches", name), True)
            if fold:
                self._fs.delete(self._at("folds", fold), True)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs without text, with n_tokens; null text has none. Columns named n_tokens are replaced."""
    docs = docs.drop("n_tokens")
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept).withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenCache(tokenizer)
        for batch in slices(batches, "text", ENCODE_BYTES):
            counts = [len(x) // 4 for x in cache.encode_all(batch.column("text").fill_null("").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(counts, pa.int64())], names=[*kept, "n_tokens"])

    return docs.mapInArrow(run, schema)


def signed(counted: DataFrame, sign: int, version: str, n_docs: Column | None = None) -> DataFrame:
    """Counted documents as deltas of one tokenizer version: +1 inserts, -1 deletes."""
    docs = F.lit(1) if n_docs is None else n_docs
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), (docs * sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))


def revised(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """Deltas that take back old counts of the same documents and add new ones."""
    return signed(old, -1, version).unionByName(signed(new, 1, version))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of documents after three batches: all documents with a count guessed from bytes, the revision to real
    counts, the deletion of all copies of a text but that of the least doc_id; the revision is sent twice. Null texts
    count as empty ones; an empty table has no totals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    fingerprint = F.xxhash64(F.coalesce("text", F.lit(""))), F.crc32(F.coalesce("text", F.lit("")))
    wide = docs.withColumns({"low": fingerprint[0], "high": fingerprint[1], "guess": F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long")})
    counted = scratch(token_counts(wide), "token-counts")
    rollup = Rollup(spark, scratch_path(spark, "token-rollup"))
    guessed = counted.withColumn("n_tokens", F.col("guess"))
    rollup.commit("insert", signed(guessed, 1, TOKENIZER))
    revision = revised(guessed, counted, TOKENIZER)
    rollup.commit("revise", revision)
    # all copies less one of each text: sums alone, without a join on the text's key
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang", "n_tokens")
    kept = counted.groupBy("low", "high").agg(F.min(row).alias("kept")).select("kept.*")
    rollup.commit("delete-copies", signed(counted, -1, TOKENIZER).unionByName(signed(kept, 1, TOKENIZER)))
    rollup.commit("revise", revision)
    return rollup.totals()
