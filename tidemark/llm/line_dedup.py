"""Line dedup by a sharded minimal perfect hash.

Spark counts the 128-bit hashes of lines (hashes are shuffled, after a map-side partial aggregate, never lines).
The hashes that are found in enough documents are dealt by their first bits into shards of some ten thousand; each
shard gets a minimal perfect hash (levels of bit arrays, after the published BBHash construction) that indexes
three arrays: fingerprints, document counts and keepers. Documents probe these arrays, line by line.

The arrays go to every executor while they are under ARRAY_BYTES. Above it they stay in Spark, a row a shard: each
partition streams its own shards past the requests of the documents, salted by document, and sends back what is
to be dropped."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, slices, texts

ARRAY_BYTES = 64 << 20
KEYS_PER_SHARD = 20_000
GAMMA = 2.0
#: Bytes of text that are looked at together; a longer text stays whole, alone.
TEXT_BYTES = 4 << 20
NONE = -(1 << 63)


def line_keys(text: bytes, min_chars: int) -> list[tuple[bytes, bytes | None]]:
    """Each line with its 128-bit hash, or None where the key (stripped of ASCII white space, A-Z in lower case)
    has under min_chars code points."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        n = len(key)
        if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            out.append((line, None))
        else:
            out.append((line, xxhash.xxh3_128_digest(key)))
    return out


class PerfectHash:
    """Levels of bit arrays: a key's slot is the count of set bits before the first of its bits that is set. Bits stay
    packed in words, with the count of bits before each word: under five bits a key in all."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        left = np.unique(keys)
        while len(left):
            words = max(1, int(GAMMA * len(left)) // 64 + 1)
            at = self._at(left, len(self.levels), words * 64)
            once = np.bincount(at, minlength=words * 64) == 1
            self.levels.append(np.packbits(once, bitorder="little").view("<u8"))
            left = left[~once[at]]
        self._rank()

    def _rank(self) -> None:
        before = 0
        self.ranks = []
        for level in self.levels:
            counts = np.bitwise_count(level).astype(np.int64)
            self.ranks.append((before + np.cumsum(counts) - counts).astype(np.int32))
            before += int(counts.sum())

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1, or another key's slot, for a key that isn't held."""
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for k, (level, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(todo):
                break
            at = self._at(keys[todo], k, len(level) * 64)
            word, bit = level[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = rank[at[hit] >> 6] + np.bitwise_count(below)
            todo = todo[~hit]
        return out

    def __getstate__(self):
        return self.levels

    def __setstate__(self, state):
        self.levels = state
        self._rank()


def build_shard(low: np.ndarray, high: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> bytes:
    table = PerfectHash(low)
    slots = table.slots(low)
    arrays = [np.empty(len(low), t) for t in (np.uint64, np.int32, np.int64)]
    for array, values in zip(arrays, (high, np.minimum(counts, (1 << 31) - 1), keepers), strict=True):
        array[slots] = values
    return pickle.dumps((table, *arrays), protocol=5)


def probe(shard: tuple, low: np.ndarray, high: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the shard holds with at least so many documents, and their keepers."""
    table, prints, counts, keepers = shard
    slots = table.slots(low)
    held = (slots >= 0) & (prints[slots] == high) & (counts[slots] >= min_docs)
    return held, np.where(held, keepers[slots], 0)


def _hash_rows(batches: Iterator[pa.RecordBatch], min_chars: int, shards: int | None) -> Iterator[pa.RecordBatch]:
    """The distinct line hashes of each document, with the shard if shards are given."""
    for batch in slices(batches, "text", TEXT_BYTES):
        digests, docs = [], []
        ids = batch.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, texts(batch), strict=True):
            found = {h for _, h in line_keys(text, min_chars) if h}
            digests.extend(found)
            docs.extend([NONE if doc_id is None else doc_id] * len(found))
        both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        low, high = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        columns = {"low": low.view(np.int64), "high": high.view(np.int64), "doc_id": np.array(docs, np.int64)}
        if shards:
            columns["shard"] = (low % np.uint64(shards)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """low, high, n_docs, keeper (largest doc_id) of line keys found in at least min_docs rows of docs."""
    hashes = docs.select("doc_id", "text").mapInArrow(lambda it: _hash_rows(it, min_chars, None), "low long, high long, doc_id long")
    counted = hashes.groupBy("low", "high").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return scratch(counted.filter(F.col("n_docs") >= min_docs), "lines")


def shard_arrays(lines: DataFrame, shards: int) -> DataFrame:
    """shard, arrays: a minimal perfect hash and its arrays for each shard of hashes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = build_shard(pdf["low"].to_numpy().view(np.uint64), pdf["high"].to_numpy().view(np.uint64), pdf["n_docs"].to_numpy(), pdf["keeper"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "arrays": [blob]})

    return lines.withColumn("shard", _unsigned_mod(F.col("low"), shards)).groupBy("shard").applyInPandas(build, "shard long, arrays binary")


def _unsigned_mod(value, n: int):
    """value, read as unsigned, modulo n, by whole numbers that stay in range."""
    high, low = F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(0xFFFFFFFF))
    return ((high % n) * F.lit((1 << 32) % n) + low) % n


def _apply(doc_id: int | None, text: bytes, keys: list, drop: set) -> tuple:
    kept = [line for line, h in keys if h is None or h not in drop]
    return doc_id, len(keys), len(keys) - len(kept), b"\n".join(kept)


OUT = "doc_id long, n_lines long, n_dropped long, kept string, kept_sha256 string"


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    ids, lines, dropped, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
    digests = [hashlib.sha256(x).hexdigest() for x in kept]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
        names=["doc_id", "n_lines", "n_dropped", "kept", "kept_sha256"],
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text left) and kept_sha256 for each row of docs.

    A line whose key has at least min_chars code points and is found in at least min_docs rows goes, except in the
    largest doc_id that holds it. Null or empty text is one empty line. Each row counts as a document of its own;
    rows that repeat the keeping doc_id all keep the line. A null doc_id is smaller than any other."""
    lines = repeated_lines(docs, min_chars, min_docs)
    n = lines.count()
    shards = max(1, -(-n // KEYS_PER_SHARD))
    arrays = scratch(shard_arrays(lines, shards), "line-arrays")
    if n * 24 <= array_bytes:
        return _probe_local(docs, arrays, shards, min_chars, min_docs)
    return _probe_streamed(docs, arrays, shards, min_chars, min_docs)


def _probe_local(docs: DataFrame, arrays: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([(r["shard"], bytes(r["arrays"])) for r in arrays.collect()])
    opened: dict[int, tuple] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not opened:
            opened.update((k, pickle.loads(v)) for k, v in held.value)
        for batch in slices(batches, "text", TEXT_BYTES):
            ids = batch.column("doc_id").to_pylist()
            keyed = [line_keys(text, min_chars) for text in texts(batch)]
            asked = list({h for keys in keyed for _, h in keys if h})
            both = np.frombuffer(b"".join(asked), "<u8").reshape(-1, 2)
            low, high = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            shard = (low % np.uint64(shards)).astype(np.int64)
            keeper: dict[bytes, int] = {}
            for k in np.unique(shard):
                if k in opened:
                    at = np.flatnonzero(shard == k)
                    found, keep = probe(opened[k], low[at], high[at], min_docs)
                    keeper.update((asked[i], v) for i, v in zip(at[found].tolist(), keep[found].tolist(), strict=True))
            rows = []
            for doc_id, keys in zip(ids, keyed, strict=True):
                own = NONE if doc_id is None else doc_id
                rows.append(_apply(doc_id, b"", keys, {h for _, h in keys if h and keeper.get(h, own) != own}))
            yield _emit(rows)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


SALTS = 16


def _probe_streamed(docs: DataFrame, arrays: DataFrame, shards: int, min_chars: int, min_docs: int) -> DataFrame:
    asked = docs.select("doc_id", "text").mapInArrow(lambda it: _hash_rows(it, min_chars, shards), "low long, high long, doc_id long, shard long")
    asked = asked.withColumn("salt", F.pmod(F.col("doc_id"), F.lit(SALTS)))
    held = arrays.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    both = asked.unionByName(held, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, at = None, None
        for batch in batches:
            pdf = batch.to_pandas()
            for key, part in pdf.groupby(["shard", "salt"], sort=False):
                if len(blobs := part["arrays"].dropna()):
                    opened, at = pickle.loads(blobs.iloc[0]), key
                rows = part[part["arrays"].isna()]
                if len(rows) and at == key:
                    low, high = (rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("low", "high"))
                    found, keeper = probe(opened, low, high, min_docs)
                    doc = rows["doc_id"].to_numpy().astype(np.int64)
                    drop = found & (keeper != doc)
                    hashes = [a.tobytes() + b.tobytes() for a, b in zip(low[drop], high[drop], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[drop], pa.int64()), "hash": pa.array(hashes, pa.binary())})

    key = ["shard", "salt"]
    asked_first = both.repartition(*key).sortWithinPartitions(*key, F.col("arrays").isNull())
    # long columns with nulls would pass through floats in pandas: rows of arrays get zeros
    asked_first = asked_first.fillna(0, ["low", "high", "doc_id"])
    drops = asked_first.mapInArrow(run, "doc_id long, hash binary").groupBy("doc_id").agg(F.collect_set("hash").alias("drops"))
    own = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NONE)).alias("_key"))
    with_drops = own.join(drops.withColumnRenamed("doc_id", "_key"), "_key", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            cols = zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("drops").to_pylist(), strict=True)
            yield _emit([_apply(d, t, line_keys(t, min_chars), set(x or ())) for d, t, x in cols])

    return with_drops.select("doc_id", "text", "drops").mapInArrow(cut, OUT)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


OP1_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(string_split(text, chr(10)), ['']) AS lines FROM documents
), each AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
), found AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, pos, line, (keeper IS NOT NULL AND keeper <> doc_id) AS gone FROM keyed LEFT JOIN found USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
