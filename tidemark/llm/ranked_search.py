"""Ranked lexical search over inverted treaps.

The index is cut into shards of documents. In a shard each term's postings form a treap: a search tree by the document's
place in doc_id order, a heap by impact, so that a subtree's root holds the greatest impact of its stretch of documents.
Treaps are stored root first (a node, its left subtree, its right one) as flat arrays: document, impact, size of the left
subtree. A search descends the treaps of all terms of an item at once: a stretch of documents is bounded by the sum of its
subtrees' roots, split at the document of the root that contributes most, and dropped with all its subtrees once the
sum cannot enter the k best. Stretches are taken from the greatest bound on, a bounded number at a time, and a task
carries each item's k best from shard to shard.

The index holds every term of every document and is written by the tasks that read the documents, without a shuffle.
Items come in blocks of bounded size (a pass over the postings of their terms for each), like those of op9."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined, mix, scratch, scratch_path, slices, texts, words
from .decontaminate import _blocks
from .terms import stretches, table

#: Bytes of text and documents a shard; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 18
#: Cells (stretches times terms) of one step of a search.
STEP_CELLS = 1 << 15
#: Stands for a doc_id that is null: it comes last among equals.
NO_ID = (1 << 63) - 1
_TERMS = table(digits=True)
_INSIDE = np.array([x != 32 for x in _TERMS])

POSTINGS = "term string, shard long, df int, docs array<int>, impacts array<int>, lefts array<int>, ids array<long>"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def lengths(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The m of documents of so many terms."""
    if int(sizes.max(initial=0)) * 75 * n_docs < 1 << 63:
        return 25 + sizes * 75 * n_docs // n_terms
    return np.array([25 + 75 * int(n) * n_docs // n_terms for n in sizes], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 10**9 * tf // (1000 * tf + 8 * m)


def treaps(starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of postings in document order, end to end: the posting that each place of the root-first layout holds,
    and the size of its left subtree. Of equal impacts a hash decides, so that trees stay flat. All lists go down one
    level at a time."""
    order, left = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int32)
    place = np.arange(len(docs)) - np.repeat(starts, ends - starts)
    chance = mix(docs.astype(np.uint64) + np.uint64(1)) >> np.uint64(42)
    key = np.append(impact.astype(np.int64) << 42 | chance.astype(np.int64) << 20 | place, 0)
    base, out = starts, starts
    low, high = starts, ends
    while len(low):
        edges = np.empty(2 * len(low), np.int64)
        edges[0::2], edges[1::2] = low, high
        root = base + (np.maximum.reduceat(key, edges)[0::2] & ((1 << 20) - 1))
        order[out], left[out] = root, root - low
        sides = [(low, root, base, out + 1), (root + 1, high, base, out + 1 + root - low)]
        full = [side[0] < side[1] for side in sides]
        low, high, base, out = (np.concatenate([side[k][f] for side, f in zip(sides, full, strict=True)]) for k in range(4))
        by = np.argsort(low, kind="stable")
        low, high, base, out = low[by], high[by], base[by], out[by]
    return order, left


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_docs = n_terms = 0
    for batch in slices(batches, "text"):
        data, offsets = joined(texts(batch))
        found = np.diff(words(data, offsets, _INSIDE)[2])
        n_docs, n_terms = n_docs + int((found > 0).sum()), n_terms + int(found.sum())
    yield pa.RecordBatch.from_pydict({"n_docs": [n_docs], "n_terms": [n_terms]})


def _shard(docs: list[tuple[int | None, bytes]], shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """A row of treap arrays for each term, after a row with the doc_ids in order."""
    docs.sort(key=lambda d: (d[0] is None, d[0]))
    vocabulary: dict[bytes, int] = {}
    ids, sizes, term, tf = [], [], [], []
    for doc_id, text in docs:
        own: Counter = Counter()
        for found in stretches(text, _TERMS):
            own.update(found)
        if own:
            ids.append(doc_id)
            term.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in own), np.int64, len(own)))
            tf.append(np.fromiter(own.values(), np.int64, len(own)))
            sizes.append(int(tf[-1].sum()))
    if not ids:
        return
    doc = np.repeat(np.arange(len(ids)), [len(t) for t in term])
    flat, tf = np.concatenate(term), np.concatenate(tf)
    by = np.argsort(flat, kind="stable")
    flat, doc = flat[by], doc[by]
    impact = impacts(tf[by], lengths(np.array(sizes, np.int64), n_docs, n_terms)[doc])
    df = np.bincount(flat, minlength=len(vocabulary))
    ends = np.cumsum(df)
    order, left = treaps(ends - df, ends, doc, impact)
    offsets = pa.array(np.append(0, ends), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (doc[order], impact[order], left)]
    names = ["term", "shard", "df", "docs", "impacts", "lefts", "ids"]
    none = pa.nulls(1, pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([shard]), pa.array([0], pa.int32()), none, none, none, pa.array([ids], pa.list_(pa.int64()))], names=names)
    n = len(vocabulary)
    yield pa.RecordBatch.from_arrays([pa.array(list(vocabulary), pa.binary()).cast(pa.string()), pa.array(np.full(n, shard)), pa.array(df.astype(np.int32)), *lists, pa.nulls(n, pa.list_(pa.int64()))], names=names)


@dataclass
class Index:
    """Postings under path, and the numbers that scores need: documents with a term, and their terms."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, path: str) -> Index:
    """Writes the index of doc_id and text of every row. Null and empty texts have no terms and aren't found; rows that
    repeat a doc_id are documents each by itself; other columns aren't read."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = own.select("text").mapInArrow(_sizes, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                if held and (size + len(text) > SHARD_BYTES or len(held) == SHARD_DOCS):
                    yield from _shard(held, shard, n_docs, n_terms)
                    shard, held, size = shard + 1, [], 0
                held.append((doc_id, text))
                size += len(text)
        yield from _shard(held, shard, n_docs, n_terms)

    own.mapInArrow(run, POSTINGS).write.option("compression", "zstd").parquet(path)
    return Index(docs.sparkSession.read.parquet(path), n_docs, n_terms)


class Best:
    """The k best (score, doc_id) so far, ties by the lesser doc_id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        by = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[by], ids[by]

    def may_enter(self, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether a document from least_id on with at most this score could be among the k."""
        if len(self.scores) < self.k:
            return bound > 0
        return (bound > self.scores[-1]) | ((bound == self.scores[-1]) & (least_id < self.ids[-1]))


@dataclass
class Shard:
    """Treaps of one shard, end to end; a subtree is a place and the end of its stretch."""

    ids: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    lefts: np.ndarray

    def narrowed(self, at: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of subtrees, those whose roots are the first inside (low, high) of their row; at and end are the
        caller's own and change."""
        out_at, out_end = at.ravel(), end.ravel()
        cells = np.flatnonzero(out_at < out_end)
        rows = cells // at.shape[1]
        node, stop, low, high = out_at[cells], out_end[cells], low[rows], high[rows]
        while len(cells):
            doc = self.docs[node]
            right = doc <= low
            moved = np.flatnonzero(right | (doc >= high))
            cells, node, stop, low, high, right = (x[moved] for x in (cells, node, stop, low, high, right))
            first = node + 1
            after = first + self.lefts[node]
            node, stop = np.where(right, after, first), np.where(right, stop, after)
            out_at[cells], out_end[cells] = node, stop
            full = np.flatnonzero(node < stop)
            cells, node, stop, low, high = (x[full] for x in (cells, node, stop, low, high))
        return out_at.reshape(at.shape), out_end.reshape(at.shape)

    def parts(self, at: np.ndarray, end: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What each subtree's root adds to a score."""
        out = np.zeros(at.shape, np.int64)
        rows, columns = np.nonzero(at < end)
        out[rows, columns] = weights[columns] * self.impacts[at[rows, columns]]
        return out

    def search(self, roots: np.ndarray, ends: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds this shard's documents to the best: all treaps of an item are descended together."""
        at, end = roots[None, :], ends[None, :]
        low, high = np.array([-1]), np.array([len(self.ids)])
        bound = self.parts(at, end, weights).sum(axis=1)
        step = max(1, STEP_CELLS // len(roots))
        while True:
            open_ = np.flatnonzero(best.may_enter(bound, self.ids[low + 1]))
            if not len(open_):
                return
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            now, later = open_[:step], open_[step:]
            own_at, own_end, own_low, own_high = at[now], end[now], low[now], high[now]
            lead = self.parts(own_at, own_end, weights).argmax(axis=1)
            doc = self.docs[own_at[np.arange(len(now)), lead]].astype(np.int64)
            lows, highs = np.stack([doc - 1, own_low, doc]), np.stack([doc + 1, doc, own_high])  # the document, and its two sides
            three_at, three_end = self.narrowed(np.tile(own_at, (3, 1)), np.tile(own_end, (3, 1)), lows.ravel(), highs.ravel())
            score, *bounds = self.parts(three_at, three_end, weights).sum(axis=1).reshape(3, -1)
            best.add(score, self.ids[doc])
            n = len(now)
            sides = [(three_at[k * n : (k + 1) * n], three_end[k * n : (k + 1) * n], lows[k], highs[k]) for k in (1, 2)]
            full = [b > 0 for b in bounds]
            at, end, low, high = (np.concatenate([x[later], *(side[k][f] for side, f in zip(sides, full, strict=True))]) for k, x in enumerate((at, end, low, high)))
            bound = np.concatenate([bound[later], *(b[f] for b, f in zip(bounds, full, strict=True))])


Query = tuple[int, int | None, dict[str, int]]
FOUND = "number int, item_id long, doc_id long, score long"


def _searched(batches: Iterator[pa.RecordBatch], queries: list[Query], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each item over this task's shards, whose rows come together, the row of doc_ids first."""
    best = [Best(k) for _ in queries]
    ids, held, place, size = None, [], {}, 0

    def finish() -> None:
        if ids is None or not held:
            return
        shard = Shard(ids, *(np.concatenate([h[i] for h in held]) for i in range(3)))
        for (_, _, weights), own in zip(queries, best, strict=True):
            found = [(*place[t], w) for t, w in weights.items() if t in place]
            if found:
                start, end, w = np.array(found, np.int64).T
                shard.search(start, end, w, own)

    last = None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if shards[a] != last:
                finish()
                last, ids, held, place, size = shards[a], None, [], {}, 0
            part = batch.slice(a, b - a)
            terms = part.column("term").to_pylist()
            if terms[0] is None:
                ids = part.column("ids")[0].values.fill_null(NO_ID).to_numpy(zero_copy_only=False)
                part, terms = part.slice(1), terms[1:]
            counts = part.column("df").to_numpy()
            ends = size + np.cumsum(counts)
            place |= {t: (e - c, e) for t, c, e in zip(terms, counts.tolist(), ends.tolist(), strict=True)}
            size += int(counts.sum())
            held.append([part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("docs", "impacts", "lefts")])
    finish()
    rows = [(number, item, None if i == NO_ID else i, s) for (number, item, _), own in zip(queries, best, strict=True) for s, i in zip(own.scores.tolist(), own.ids.tolist(), strict=True)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["number", "item_id", "doc_id", "score"])


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items, all if fewer have a score.

    Null or empty items, and those whose terms no document holds, have no rows; rows of items that repeat an item_id are
    ranked each by itself; a null item_id is carried; equal scores come by doc_id, a null one last."""
    spark = index.postings.sparkSession
    out = spark.createDataFrame([], FOUND)
    number = 0
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        own = [(item, Counter(t.decode() for found in stretches(text, _TERMS) for t in found)) for item, text in block]
        names = spark.createDataFrame([(t,) for t in sorted({t for _, c in own for t in c})], "term string")  # of one block of items
        of_block = index.postings.join(F.broadcast(names), "term", "left_semi")
        df = {r["term"]: r["df"] for r in of_block.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row a term of the block
        queries = [(number + n, item, {t: q * w for t, q in c.items() if t in df and (w := weight(index.n_docs, df[t])) > 0}) for n, (item, c) in enumerate(own)]
        number += len(queries)
        held = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            return _searched(batches, held.value, k)

        rows = of_block.unionByName(index.postings.filter("term IS NULL")).repartition("shard").sortWithinPartitions("shard", "term")
        out = out.unionByName(scratch(rows.mapInArrow(run, FOUND), f"found-{uuid.uuid4().hex[:6]}"))
    by = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "treap-index"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
items AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM benchmark
),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs WHERE len(words) > 0),
sized AS (SELECT row, doc_id, 25 + (75 * len(words) * n_docs) // n_terms AS m FROM docs, totals WHERE len(words) > 0),
of_doc AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(words) AS term FROM docs) GROUP BY ALL),
weighted AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM of_doc, totals GROUP BY term),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(words) AS term FROM items) GROUP BY ALL),
scored AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weighted USING (term) JOIN of_doc USING (term) JOIN sized USING (row) GROUP BY item_id, row
)
SELECT item_id, place::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0) WHERE place <= 10
"""
