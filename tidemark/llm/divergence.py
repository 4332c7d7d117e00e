"""An audit of how sources of one language differ in their words, by two-dimensional group-block tiling.

Groups (lang, source) of a language are numbered and cut into blocks, its kept terms into chunks. The counts of a block
in a chunk are packed into one row; each packed row is replicated to the tasks (block, block, stripe of chunks) that need
it. A task goes through its chunks one after the other, unpacks the two blocks into matrices of shares and adds the
chunk's part to its submatrix of pairs. What tasks hold is bounded by two blocks and one chunk.

Chunks in which neither block holds a term have no rows: their part follows from the groups' sizes alone and is added at
the end. All arithmetic is in whole numbers of 64 bits; shares are divided three decimal digits at a time, exact while a
group has less than 9e15 terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, slices, small, texts
from .terms import stretches, table

#: A term is kept in a language if so many of its documents hold it; each count is raised by SMOOTH.
LEAST_DOCS, SMOOTH = 10, 2
#: Groups a block, terms a chunk (on average), chunks a task.
BLOCK, CHUNK, STRIPE = 64, 4_096, 64
#: Terms that a task counts before it hands its counts on.
HELD_TERMS = 400_000
_LETTERS = table(digits=False)

COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each group's terms, summed as far as memory allows; a row without a term stands for
    the group itself."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed_on() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in counts.items():
            rows = len(n) + 1
            for column, part in zip(columns, ([lang] * rows, [source] * rows, [None, *n], [0, *n.values()], [0, *(docs[t] for t in n)]), strict=True):
                column += part
        counts.clear()
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    for batch in slices(batches, "text"):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts(batch), strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for terms in stretches(text, _LETTERS):
                n.update(terms)
                own.update(terms)
            docs.update(own)
        if sum(len(n) for n, _ in counts.values()) > HELD_TERMS or len(counts) > HELD_TERMS // 10:
            yield handed_on()
    yield handed_on()


def share(count: str, n: str, v: str) -> str:
    """SQL for 1 + floor(10**9 * (count + SMOOTH) / (n + SMOOTH * v))."""
    a, d = f"({count} + {SMOOTH})", f"({n} + {SMOOTH} * {v})"
    first, second = f"({a} * 1000 % {d})", f"(({a} * 1000 % {d}) * 1000 % {d})"
    return f"(1 + ({a} * 1000 div {d}) * 1000000 + ({first} * 1000 div {d}) * 1000 + ({second} * 1000 div {d}))"


def shares(count: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """The same of arrays."""
    rest, total, out = count + SMOOTH, n + SMOOTH * v, np.int64(0)
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def apart(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


TILE_KEY = ["lang", "low", "high", "stripe"]
TILE_CELLS = "array<struct<gid: int, pos: int, n: long>>"
PARTS = "lang string, a int, b int, part long, covered long"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The submatrix of each task's pairs, from its packed rows in the order of chunks."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):  # a packed row is large: one at a time
                yield {name: batch.column(name)[k] for name in batch.schema.names}

    def matrix(packed: pa.Scalar | None, base: int, n: np.ndarray, v: int, size: int) -> np.ndarray:
        out = np.repeat(shares(np.zeros(len(n), np.int64), n, v)[:, None], size, axis=1)
        if packed is not None:
            cells = packed.values
            gid, pos, count = (cells.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            out[gid - base, pos] = shares(count.astype(np.int64), n[gid - base], v)
        return out

    for key, own in groupby(rows(), key=lambda r: tuple(r[k].as_py() for k in TILE_KEY)):
        lang, low, high, _ = key
        total, covered = None, 0
        for _, pair in groupby(own, key=lambda r: r["chunk"].as_py()):
            held = {}
            for row in pair:
                held[row["block"].as_py()] = row["cells"]
            v, size = row["v"].as_py(), row["size"].as_py()
            n_low, n_high = (row[k].values.to_numpy(zero_copy_only=False) for k in ("n_low", "n_high"))
            left = matrix(held.get(low), low * BLOCK, n_low, v, size)
            right = left if low == high else matrix(held.get(high), high * BLOCK, n_high, v, size)
            if total is None:
                total = np.zeros((len(n_low), len(n_high)), np.int64)
            for k in range(len(n_low)):
                gap = left[k] - right
                total[k] += (gap * gap // (left[k] + right)).sum(axis=1)
            covered += size
        a, b = np.nonzero(np.ones_like(total))
        a_id, b_id = a + low * BLOCK, b + high * BLOCK
        half = a_id < b_id
        count = int(half.sum())
        columns = [pa.array([lang] * count, pa.string()), pa.array(a_id[half].astype(np.int32)), pa.array(b_id[half].astype(np.int32)), pa.array(total[a, b][half]), pa.array(np.full(count, covered, np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "part", "covered"])


def audit(docs: DataFrame, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank for every group (lang, source) that occurs.

    Null lang, source and text are empty ones; an empty language or source is one like others; rows that repeat a
    doc_id are documents each by itself; other columns aren't read; no documents give no rows. A group without terms has
    its pairs; in a language without kept terms they are 0. Equal values are ranked by item, by its UTF-8 bytes."""
    own = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = own.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch(counts, "term-counts")
    held = counts.filter("term IS NOT NULL")
    kept = held.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = scratch(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("n_lang"))
    langs = scratch(langs.withColumn("chunks", F.ceil(F.col("v") / CHUNK)), "kept-langs")
    in_chunk = W.partitionBy("lang", "chunk")
    placed = kept.join(small(langs, 64), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    placed = placed.withColumns({"pos": F.row_number().over(in_chunk.orderBy("term")) - 1, "size": F.count("*").over(in_chunk)})
    cells = scratch(held.select("lang", "source", "term", "n").join(placed.select("lang", "term", "in_lang", "chunk", "pos", "size"), ["lang", "term"]), "term-cells")

    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_group", "v", "n_lang", "chunks"])
    groups = groups.withColumn("gid", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).withColumn("block", F.floor(F.col("gid") / BLOCK).cast("int"))
    groups = scratch(groups, "source-groups")

    of_group = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shared = cells.join(small(groups, 96), ["lang", "source"]).selectExpr("lang", "source", "term AS item", f"{share('n', 'n_group', 'v')} AS p", f"{share('in_lang', 'n_lang', 'v')} AS q").filter("p > q")
    terms = shared.selectExpr("lang", "source", "'term' AS part", "item", f"{apart('p', 'q')} AS value").withColumn("rank", F.row_number().over(of_group)).filter(F.col("rank") <= top)

    pairs = _pairs(cells, groups).withColumn("rank", F.row_number().over(of_group))
    return pairs.unionByName(terms)


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, part, item, value of every ordered pair of a language's groups."""
    blocks = groups.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("gid", "n_group"))).alias("own"), F.max("v").alias("v"))
    blocks = scratch(blocks.select("lang", "block", "v", F.col("own.n_group").alias("n")), "source-blocks")
    whole = blocks.groupBy("lang").agg((F.max("block") + 1).alias("n_blocks"))
    packed = cells.join(small(groups.select("lang", "source", "gid", "block"), 64), ["lang", "source"])
    packed = packed.groupBy("lang", "block", "chunk").agg(F.collect_list(F.struct("gid", "pos", "n")).alias("cells"), F.max("size").alias("size"))
    copies = packed.join(small(whole, 32), "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    copies = copies.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "stripe": F.floor(F.col("chunk") / STRIPE).cast("int")}).drop("other", "n_blocks")
    sides = small(blocks, BLOCK * 8 + 64)
    copies = copies.join(sides.select("lang", F.col("block").alias("low"), "v", F.col("n").alias("n_low")), ["lang", "low"])
    copies = copies.join(sides.select("lang", F.col("block").alias("high"), F.col("n").alias("n_high")), ["lang", "high"])
    dealt = copies.repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY, "chunk", "block")
    parts = dealt.mapInArrow(_tiles, PARTS).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("covered").alias("covered"))

    side = {k: groups.select("lang", F.col("gid").alias(k), F.col("source").alias(f"source_{k}"), F.col("n_group").alias(f"n_{k}"), "v") for k in "ab"}
    both = side["a"].join(side["b"].drop("v"), "lang").filter("a < b").join(parts, ["lang", "a", "b"], "left")
    rest = f"CASE WHEN v > 0 THEN (v - coalesce(covered, 0)) * {apart(share('0', 'n_a', 'v'), share('0', 'n_b', 'v'))} ELSE 0 END"
    valued = scratch(both.selectExpr("lang", "source_a", "source_b", f"coalesce(part, 0) + {rest} AS value"), "source-pairs")
    mirrored = valued.selectExpr("lang", "source_b AS source_a", "source_a AS source_b", "value")
    return valued.unionByName(mirrored).selectExpr("lang", "source_a AS source", "'pair' AS part", "source_b AS item", "value")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
of_doc AS (SELECT row, lang, source, term, count(*) AS tf FROM (SELECT row, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(tf) AS in_lang FROM of_doc GROUP BY lang, term HAVING count(*) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS n_lang FROM kept GROUP BY lang),
cells AS (SELECT lang, source, term, sum(tf) AS n FROM of_doc JOIN kept USING (lang, term) GROUP BY ALL),
sized AS (SELECT lang, source, sum(n) AS n_group FROM cells GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(n_group, 0) AS n_group FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sized USING (lang, source)),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n_group + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.in_lang + 2)) // (l.n_lang + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 10
"""
