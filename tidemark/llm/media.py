"""Media columns as content-defined chunks.

A payload is cut where a rolling gear hash of its last bytes hits a mask, so equal stretches give equal chunks wherever
they stand. Spark joins chunk digests to find, for each chunk of the table, one owner; only owners' chunks are stored,
each compressed, in a table bucketed by digest. A payload is kept as its ordered list of digests, and is read back by
a join of the list with the chunk table, in order, and verified by its own digest.

Equal payloads are handled once: lists are keyed by the payload's SHA-256."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, CLEANUP, SALTS, joined, mix, scratch, scratch_path, slices, small, texts

UNIT, FILL = 576, 255
#: Chunk sizes in bytes: none is shorter than LEAST (but the last) or longer than MOST; cuts come every 2**BITS bytes.
LEAST, MOST, BITS = 512, 32_768, 12
#: Frames share a dictionary trained on the chunks of so many payloads, those with the least hash of doc_id, and so
#: many bytes of each; it only makes frames smaller.
DICT_DOCS, DICT_DOC_BYTES, DICT_BYTES = 1_000, 16_384, 65_536
#: The bytes that decide a cut.
SPAN = 32
_gear = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def payload(text: bytes) -> bytes:
    """text with bytes 255 up to a positive multiple of 576."""
    return text + bytes([FILL]) * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of gear values of the last SPAN bytes, each shifted left once for every byte since, by
    doubling: a window of 2n bytes is the newer n plus the older n, shifted by n."""
    out, width = _gear[data], 1
    while width < SPAN:
        older = np.zeros_like(out)
        older[width:] = out[:-width] if len(out) > width else 0
        out = out + (older << np.uint64(width))
        width *= 2
    return out


def cuts(hashes: np.ndarray) -> list[int]:
    """Ends of the chunks of one payload, from its gear hashes."""
    marks = (np.flatnonzero(hashes >> np.uint64(64 - BITS) == 0) + 1).tolist()
    n, at, ends = len(hashes), 0, []
    for mark in [*marks, n]:
        while mark - at > MOST:
            at += MOST
            ends.append(at)
        if mark - at >= LEAST or mark == n and mark > at:
            at = mark
            ends.append(at)
    return ends


def chunked(parts: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each payload. Hashes are taken over all payloads at once: the first SPAN bytes of each, where the
    window reaches into the one before, hold no cut, as LEAST is longer."""
    data, offsets = joined(parts)
    hashes = gear(data)
    for part, a, b in zip(parts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends = cuts(hashes[a:b])
        yield [part[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


LISTS = "doc_id long, n_bytes long, key binary, digests array<binary>"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        parts = texts(batch)
        whole = [payload(x) for x in parts]
        digests = [list(map(digest, found)) for found in chunked(whole)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(list(map(len, parts)), pa.int64()), pa.array([hashlib.sha256(x).digest() for x in whole]), pa.array(digests, pa.list_(pa.binary()))],
            names=["doc_id", "n_bytes", "key", "digests"],
        )


def train_dictionary(docs: DataFrame) -> bytes:
    """A zstandard dictionary; empty if there is too little to learn from."""
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = docs.filter(F.length("text") > 0).select("doc_id").distinct().orderBy(*order).limit(DICT_DOCS)
    prefixes = docs.join(F.broadcast(picked), "doc_id").select(F.substring("text", 1, DICT_DOC_BYTES).alias("text"))
    rows = [r["text"].encode() for r in prefixes.filter(F.length("text") > 0).orderBy("text").limit(DICT_DOCS).collect()]
    samples = sorted({c for each in chunked([payload(x) for x in rows]) for c in each}) if rows else []
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, dict_id=1).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def _learned(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _frames(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Each chunk of these texts with its frame, once in a batch."""
    pack = zstandard.ZstdCompressor(level=6, dict_data=_learned(dictionary), write_checksum=False, write_dict_id=False)
    for batch in slices(batches, "text"):
        found = {digest(c): c for each in chunked([payload(x) for x in texts(batch)]) for c in each}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(found), pa.binary()), "frame": pa.array([pack.compress(c) for c in found.values()], pa.binary())})


def write_media(docs: DataFrame, path: str, base: str | None = None) -> None:
    """Writes docs (doc_id, text) to path: lists/ has doc_id, n_bytes, the payload's SHA-256 and the ordered digests;
    chunks/ has each distinct chunk once, but for those that the store at base holds, whose dictionary it shares.

    Copies of a chunk are reduced to one in each task before the shuffle, so a chunk that many documents hold is sent
    once from each. The chunk table is bucketed by digest under a name of this session's catalogue."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    docs.mapInArrow(_lists, LISTS).write.option("compression", "zstd").parquet(f"{path}/lists")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dictionary = _dictionary(spark, base) if base else train_dictionary(docs)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/meta")
    distinct = docs.mapInArrow(lambda it: _frames(it, dictionary), "digest binary, frame binary").groupBy("digest").agg(F.first("frame").alias("frame"))
    if base:
        distinct = distinct.join(chunk_table(spark, base).select("digest"), "digest", "left_anti")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        distinct.write.option("compression", "none").bucketBy(n, "digest").option("path", f"{path}/chunks").saveAsTable(_name(path))
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/meta").first()["dictionary"])


def _name(path: str) -> str:
    return f"media_chunks_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of a store; by name, with its buckets, in the session that wrote it, else from its files."""
    return spark.table(_name(path)) if spark.catalog.tableExists(_name(path)) else spark.read.parquet(f"{path}/chunks")


def forget(spark: SparkSession, path: str) -> None:
    """Takes the chunk table's name out of the session's catalogue; the store's files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")


READ = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
#: A chunk that more payloads than this refer to is joined apart from the others.
HOT_REFS = 4_096


def feature(data: bytes) -> str:
    """The share of bytes in each eighth of the value range, in thousandths, and the mean absolute step."""
    values = np.frombuffer(data, np.uint8)
    shares = np.bincount(values >> 5, minlength=8) * 1000 // len(values)
    steps = int(np.abs(np.diff(values.astype(np.int16))).sum()) // max(1, len(values) - 1)
    return "-".join(map(str, [*shares.tolist(), steps]))


def _assembled(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """Payloads from frames that come ordered by key and place; each is verified by its key."""
    unpack = zstandard.ZstdDecompressor(dict_data=_learned(dictionary))
    key, frames, rows = None, [], []

    def close() -> None:
        if None in frames:
            raise ValueError(f"a chunk of payload {key.hex()} is missing")
        data = b"".join(map(unpack.decompress, frames))
        sha, media = hashlib.sha256(data), hashlib.sha256(b"".join(frames))
        if sha.digest() != key:
            raise ValueError(f"the chunks of payload {key.hex()} don't give it back")
        rows.append((key, len(data), sha.hexdigest(), zlib.crc32(data[-32:]), sum(map(len, frames)), media.hexdigest(), feature(data)))

    def out() -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])
        rows.clear()
        return batch

    for batch in batches:
        for own, frame in zip(batch.column("key").to_pylist(), batch.column("frame").to_pylist(), strict=True):
            if own != key:
                if key is not None:
                    close()
                key, frames = own, []
            frames.append(frame)
        if rows:
            yield out()
    if key is not None:
        close()
        yield out()


def read_media(spark: SparkSession, path: str, bases: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes and, from the payload read back, payload_bytes, payload_sha256, tail_crc32, media_bytes and
    media_sha256 (of the stored frames in order) and feature.

    A chunk that is missing or damaged raises: references are kept through every join, and a payload with a reference
    without a frame, or with other bytes than its digest says, isn't given back. A store of no documents has no rows."""
    lists = spark.read.parquet(f"{path}/lists")
    held = chunk_table(spark, path)
    for other in bases:
        held = held.unionByName(chunk_table(spark, other))
    distinct = lists.groupBy("key").agg(F.first("digests").alias("digests"))
    refs = scratch(distinct.select("key", F.posexplode("digests").alias("place", "digest")), "media-refs")
    hot = scratch(refs.groupBy("digest").agg(F.count("*").alias("refs")).filter(F.col("refs") > HOT_REFS).select("digest"), "media-hot")
    cold_refs = refs.join(small(hot, 64), "digest", "left_anti")
    # hot chunks are at most refs / HOT_REFS: broadcast while they are few, else dealt by place in a salted join
    hot_held = scratch(held.join(small(hot, 64), "digest", "left_semi"), "media-hot-frames")
    hot_refs = refs.join(small(hot, 64), "digest", "left_semi")
    if hot_held.count() * MOST <= BROADCAST_BYTES:
        hot_part = hot_refs.join(F.broadcast(hot_held), "digest", "left")
    else:
        salted = hot_held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot_part = hot_refs.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    parts = cold_refs.join(held, "digest", "left").select("key", "place", "frame").unionByName(hot_part.select("key", "place", "frame"))
    ordered = parts.repartition("key").sortWithinPartitions("key", "place")
    dictionary = _dictionary(spark, path)
    found = scratch(ordered.mapInArrow(lambda it: _assembled(it, dictionary), READ), "media-read")
    if found.count() != refs.filter("place = 0").count():
        raise ValueError(f"the store at {path} has other payloads than its lists say")
    return lists.drop("digests").join(found, "key").drop("key")


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    write_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    found = read_media(spark, path)
    forget(spark, path)
    return found
