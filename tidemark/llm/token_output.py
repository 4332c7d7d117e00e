"""Token ids in compressed binary files with short-document access.

A store is a folder of Parquet tables that Spark's writers commit: frames/ holds blocks of about a megabyte, each
with the separately compressed frames of consecutive documents (ids as little-endian uint32) and, as its index,
their doc_ids, the least and greatest of these, token counts and byte offsets; meta/ holds the shared zstandard
dictionary, its SHA-256, and the file format's version. A document is found by the index columns alone, whose ranges are
pushed into the scan, and read by one block's bytes and one slice of them; frames carry no other document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, scratch_path, slices, small
from .tokens import ENCODE_BYTES, TOKENIZER, TokenCache

#: The dictionary is trained on this many documents, those with the least hash of doc_id, and so many bytes of each.
DICT_DOCS, DICT_DOC_BYTES, DICT_BYTES = 1500, 8_192, 65_536
BLOCK_BYTES = 1 << 20
END_ID = 0
FORMAT = 2
#: Bytes of a group of blocks in a file: what a reader fetches to get at one block.
GROUP_BYTES = 8 << 20


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary from the serialized id arrays of a bounded sample; empty if there is too little."""
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = docs.select("doc_id").distinct().orderBy(*order).limit(DICT_DOCS)  # ids alone: no text is read for it
    prefixes = docs.join(F.broadcast(picked), "doc_id").select(F.substring("text", 1, DICT_DOC_BYTES).alias("text"))
    sample = prefixes.filter(F.length("text") > 0).orderBy("text").limit(DICT_DOCS)
    cache = TokenCache(tokenizer)
    serialized = [cache.encode(r["text"].encode())[:DICT_DOC_BYTES] for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, serialized, dict_id=1).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def _open(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


FRAMES = "shard int, block int, first_id long, last_id long, doc_ids array<long>, n_tokens array<int>, ends array<int>, data binary, dict_hash string"


def _frames(batches: Iterator[pa.RecordBatch], tokenizer: str, dictionary: bytes, block_bytes: int) -> Iterator[pa.RecordBatch]:
    cache, digest = TokenCache(tokenizer), hashlib.sha256(dictionary).hexdigest()
    pack = zstandard.ZstdCompressor(level=3, dict_data=_open(dictionary), write_content_size=True, write_checksum=True)
    shard, block = TaskContext.get().partitionId(), 0
    ids, counts, ends, data = [], [], [], bytearray()

    def full() -> pa.RecordBatch:
        ends_of = [next((i for i in order if i is not None), None) for order in (ids, reversed(ids))]
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), *(pa.array([i], pa.int64()) for i in ends_of), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int32())), pa.array([bytes(data)], pa.binary()), pa.array([digest])],
            names=["shard", "block", "first_id", "last_id", "doc_ids", "n_tokens", "ends", "data", "dict_hash"],
        )

    for batch in slices(batches, "text", ENCODE_BYTES):
        own = batch.column("doc_id").to_pylist()
        for doc_id, encoded in zip(own, cache.encode_all(batch.column("text").fill_null("").to_pylist()), strict=True):
            encoded += END_ID.to_bytes(4, "little")
            data += pack.compress(encoded)
            ids.append(doc_id)
            counts.append(len(encoded) // 4)
            ends.append(len(data))
            if len(data) >= block_bytes:
                yield full()
                block, ids, counts, ends, data = block + 1, [], [], [], bytearray()
    if ids:
        yield full()


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes docs (doc_id, text) to path in ascending doc_id order (null first; equal ids by text).

    Documents are range-partitioned by doc_id before they are encoded, so each is encoded once and a task's
    blocks are in order. Null text is empty; rows that repeat a doc_id or a text are documents of their own, next to each
    other; other columns are not read; an empty table gives a store without blocks."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda it: _frames(it, tokenizer, dictionary, block_bytes), FRAMES).write.option("compression", "none").option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/frames")
    meta = [(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest(), FORMAT)]
    spark.createDataFrame(meta, "dictionary binary, dict_hash string, format int").coalesce(1).write.parquet(f"{path}/meta")


DECODED = "shard int, block int, doc_id long, before long, n_tokens long, ids_crc32 long"


def _decode(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    digest = hashlib.sha256(dictionary).hexdigest()
    unpack = zstandard.ZstdDecompressor(dict_data=_open(dictionary))
    for batch in batches:
        for row in batch.to_pylist():
            if row["dict_hash"] != digest:
                raise ValueError("a block was written with another dictionary")
            start, sizes, sums = 0, [], []
            for end in row["ends"]:
                ids = unpack.decompress(row["data"][start:end])
                sizes.append(len(ids) // 4)
                sums.append(zlib.crc32(ids))
                start = end
            if sizes != row["n_tokens"]:
                raise ValueError("a frame holds another number of ids than the index says")
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["shard"]] * n, pa.int32()),
                    pa.array([row["block"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(np.cumsum([0, *sizes[:-1]], dtype=np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["shard", "block", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def _meta(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/meta").first()
    if row["format"] != FORMAT or hashlib.sha256(row["dictionary"]).hexdigest() != row["dict_hash"]:
        raise ValueError("the store's dictionary or format isn't as written")
    return bytes(row["dictionary"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32, from the files.

    Starts are sums in three steps: over shards (one row a shard in the only window without a key), over the blocks
    of a shard, and over the documents of a block as it is decoded. Blocks' sums, a row for a megabyte of frames, are
    broadcast while small; documents are shuffled for them only beyond that."""
    dictionary = _meta(spark, path)
    frames = spark.read.parquet(f"{path}/frames")
    sizes = frames.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    in_shard = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sizes.withColumn("offset", F.coalesce(F.sum("n").over(in_shard), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("offset")).alias("base"))
    docs = frames.mapInArrow(lambda it: _decode(it, dictionary), DECODED)
    found = docs.join(small(scratch(blocks, "token-blocks"), 40), ["shard", "block"])
    return found.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def blocks_of(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The blocks whose range of doc_ids holds one: both bounds are pushed into the scan."""
    return spark.read.parquet(f"{path}/frames").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document (of rows that share a doc_id the first): its block by the index columns, then the bytes of
    that block, one slice and one frame."""
    dictionary = _meta(spark, path)
    index = blocks_of(spark, path, doc_id).filter(F.array_contains("doc_ids", F.lit(doc_id)))
    row = index.select("shard", "block", "doc_ids", "ends").orderBy("shard", "block").first()
    if row is None:
        return None
    k = row["doc_ids"].index(doc_id)
    start, end = row["ends"][k - 1] if k else 0, row["ends"][k]
    own = blocks_of(spark, path, doc_id).filter((F.col("shard") == row["shard"]) & (F.col("block") == row["block"]))
    frame = bytes(own.select(F.substring("data", start + 1, end - start).alias("frame")).first()["frame"])
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=_open(dictionary)).decompress(frame), "<u4").tolist()


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path)
