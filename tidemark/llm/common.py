"""What the text operators share: scratch tables in the cluster's shared folder, checked broadcasts, and
vectorised word hashing over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Largest table, by estimate, that is sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that are turned into NumPy arrays at once.
SLICE_BYTES = 512 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the one set by setCheckpointDir. A single-process
    session without either gets one of its own; a cluster must name it, as no folder of one machine would do."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if not (found := context.getCheckpointDir()):
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = context.getCheckpointDir()
    return found


_made: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the driver ends."""
    root = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}"
    if root not in _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    The shuffle files of the plan are dropped once the table stands."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, None)
    try:
        spark.conf.set(CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(df: DataFrame) -> None:
    """Deletes the files of a scratch table that no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows, counted, stay under limit; else df, which is then joined by a shuffle.

    df should be a scratch table, whose count is read from file footers."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


#: Rows with one key beyond which a join takes the key apart from the others, and the tasks that then share it.
HOT_ROWS, SALTS = 1_024, 16


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str, deal_by: str) -> DataFrame:
    """left joined by keys with right, a scratch table with one row a key whose column rows (dropped) says how many rows
    of left the key has.

    Keys of over HOT_ROWS rows, at most one for so many rows of left, meet left without a shuffle while they are few;
    beyond that each is dealt to SALTS tasks by the column deal_by of left."""
    cold = F.col(rows) <= HOT_ROWS
    hot = right.filter(~cold).drop(rows)
    if hot.isEmpty():
        return left.join(right.drop(rows), keys)
    hot = scratch(hot, "hot-keys")
    names = small(hot.select(*keys), 16 * len(keys))
    plain = left.join(names, keys, "left_anti").join(right.filter(cold).drop(rows), keys)
    if hot.count() * 100 <= BROADCAST_BYTES:
        return plain.unionByName(left.join(F.broadcast(hot), keys))
    salted = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = left.join(names, keys, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(deal_by), F.lit(SALTS)).cast("int"))
    return plain.unionByName(dealt.join(salted, [*keys, "_salt"]).drop("_salt"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column's bytes stay near limit; a longer text stays whole, alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one array, and the offsets of each (one more than parts)."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums H such that (H[e] - H[s]) * down[s] names data[s:e]."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


#: ASCII letters in lower case; white space; the bytes of words (all but ASCII white space); alphanumeric words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes marked by of_word, never across offsets, and for each offset
    how many runs start before it."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = of_word[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[1:-1][edges]
    ends[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = prefix_hash(data)
    _, down = powers(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(parts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each lower-cased text its distinct shingle hashes, ascending, end to end, and the offsets of each.

    A text of fewer words than size has its whole sequence as one shingle; one without words has none."""
    data, offsets = joined(parts)
    data = LOWER[data]
    starts, ends, first = words(data, offsets, NOT_SPACE)
    counts = np.diff(first)
    values = word_hashes(data, starts, ends)
    n = len(values)
    if n >= size:
        rolled = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            rolled = mix(rolled + values[j : n - size + 1 + j]) + np.uint64(j + 1)
    else:
        rolled = np.zeros(0, np.uint64)
    out, sizes = [], np.zeros(len(parts) + 1, np.int64)
    for i, (at, count) in enumerate(zip(first[:-1].tolist(), counts.tolist(), strict=True)):
        if count >= size:
            found = np.unique(rolled[at : at + count - size + 1])
        elif count:
            short = np.zeros(1, np.uint64)
            for j in range(count):
                short = mix(short + values[at + j : at + j + 1]) + np.uint64(j + 101 * count)
            found = short
        else:
            found = rolled[:0]
        out.append(found)
        sizes[i + 1] = sizes[i] + len(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes
