"""A quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled rows are web text whatever its label. The class prior is estimated
from the texts of both alone: the share of good rows in unlabelled text is at most the ratio of the two kinds' shares above
any score, and near it where hardly any other row scores as high (mixture proportions by the best bin). A logistic model
over text statistics minimises the non-negative unbiased risk
prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)).

Only the fit sees a sample, bounded by MAX_POSITIVE and MAX_UNLABELLED rows (those with the least hash of doc_id, of
rows that repeat one those with the least statistics); its statistics are computed by executors, and the driver gets one short vector a row. Every document is scored."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, scratch, slices, texts

#: Rows that the fit and the prior's estimate may see.
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
THRESHOLD, STEPS, RATE, DECAY = 0.7, 600, 0.05, 1e-4
#: The prior's bound fails with this chance at most; of bounds this near the least one the widest bin's is taken.
DOUBT, NEAR = 0.1, 0.02
#: Bytes of text that are looked at together; a longer text stays whole, alone.
TEXT_BYTES = 4 << 20

_SYMBOLS = b"#$%&*|<>{}[]@^~=+_\\/"
_UPPERS, _HIGH = bytes(range(65, 91)), bytes(range(128, 256))
_CONTROLS = bytes([*range(9), 11, 12, *range(14, 32), 127])
NAMES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "bangs", "stops", "commas", "pipes", "lines", "distinct_words",
    "repeats", "top_word", "distinct_lines", "long_words", "ascii", "capital_words", "short_words", "controls", "distinct_pairs", "marked_words",
)


def features(text: bytes) -> list[float]:
    """Statistics of a whole text, one for each of NAMES; zeros for a text without words."""
    tokens = text.split()
    n, size = len(tokens), len(text)
    if not n:
        return [0.0] * len(NAMES)
    count = Counter(tokens)
    sizes = list(map(len, tokens))
    lines = [x for x in text.split(b"\n") if x]
    solid = sum(sizes)
    kept = len(text.translate(None, _SYMBOLS))
    pairs = max(1, n - 1)
    return [
        math.log1p(n),
        min(solid / n, 40.0),
        (size - len(text.translate(None, _UPPERS))) / solid,
        (size - len(text.translate(None, b"0123456789"))) / solid,
        (size - kept) / solid,
        min(text.count(b"!") / n, 2.0),
        min(text.count(b".") / n, 2.0),
        min(text.count(b",") / n, 2.0),
        min(text.count(b"|") / n, 2.0),
        min(len(lines) / n, 1.0),
        len(count) / n ** 0.8,
        sum(map(eq, tokens, tokens[1:])) / pairs,
        max(count.values()) / n,
        len(set(lines)) / len(lines),
        sum(x > 16 for x in sizes) / n,
        len(text.translate(None, _HIGH)) / size,
        sum(map(bytes.istitle, tokens)) / n,
        sum(x <= 2 for x in sizes) / n,
        (size - len(text.translate(None, _CONTROLS))) / size,
        len(set(zip(tokens, tokens[1:], strict=False))) / pairs,
        sum(t[-1] in _SYMBOLS or t[-1:] == b"!" for t in tokens) / n,
    ]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from the fit: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _sums(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's margins, and the design with its constant."""
    design = np.column_stack([x, np.ones(len(x))])
    return design @ w, design


class Model:
    """A logistic model of standardised statistics, their squares included."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def inputs(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mean) / self.scale, -6, 6)
        return np.column_stack([z, z * z / 6])

    def scores(self, raw: np.ndarray) -> np.ndarray:
        margins, _ = _sums(self.inputs(raw), self.weights)
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def _descended(size: int, slope: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights after STEPS of Adam down a slope, with a small decay of all but the constant. Deterministic."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = slope(w) + DECAY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    both = np.concatenate([positive, unlabelled])
    return Model(both.mean(0), both.std(0) + 1e-9, np.zeros(2 * both.shape[1] + 1))


def best_bin(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled, from scores of both that order them.

    For the bin of all scores from a positive's on, unlabelled's share in it over positive's is the estimate, and with the
    deviations of both shares an upper bound of it; the bin of the least bound counts, or the widest of those near it."""
    p, u = np.sort(positive), np.sort(unlabelled)
    own = 1 - np.searchsorted(p, p, "left") / len(p)
    other = 1 - np.searchsorted(u, p, "left") / len(u)
    spread = sum(math.sqrt(math.log(4 / DOUBT) / (2 * n)) for n in (len(p), len(u)))
    bound = (other + spread) / own
    place = int(np.argmax(bound <= (1 + NEAR) * bound.min()))  # positives ascend: the first is the widest
    return min(float(other[place] / own[place]), 1.0)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of rows like positive among unlabelled, between 0.01 and 0.99: each half of both is scored by a model that
    tells the kinds apart and was fitted on the other half, then best_bin. One half with fewer than four rows of a kind."""
    width = len(NAMES)
    positive, unlabelled = positive.reshape(-1, width), unlabelled.reshape(-1, width)
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    model = _scaled(positive, unlabelled)
    kinds = model.inputs(positive), model.inputs(unlabelled)
    margins = [np.zeros(len(x)) for x in kinds]
    for half in (0, 1):
        own = [np.arange(len(x)) % 2 == half for x in kinds]
        p, u = (x[~o] for x, o in zip(kinds, own, strict=True))

        def slope(w: np.ndarray, p: np.ndarray = p, u: np.ndarray = u) -> np.ndarray:
            (fp, dp), (fu, du) = _sums(p, w), _sums(u, w)
            return du.T @ (1 / (1 + np.exp(-fu))) / len(u) - dp.T @ (1 / (1 + np.exp(fp))) / len(p)

        w = _descended(2 * width + 1, slope)
        for found, x, o in zip(margins, kinds, own, strict=True):
            found[o] = _sums(x[o], w)[0]
    return min(max(best_bin(*margins), 0.01), 0.99)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimises the non-negative unbiased risk with logistic loss by Adam; where the risk of the negatives falls
    below zero, the step goes against it, which keeps the estimate from overfitting. Deterministic.

    Without positives or unlabelled rows the model scores the prior."""
    width = len(NAMES)
    positive, unlabelled = positive.reshape(-1, width), unlabelled.reshape(-1, width)
    if not len(positive) or not len(unlabelled):
        w = np.zeros(2 * width + 1)
        w[-1] = math.log(prior / (1 - prior))
        return Model(np.zeros(width), np.ones(width), w)
    model = _scaled(positive, unlabelled)
    p, u = model.inputs(positive), model.inputs(unlabelled)

    def slope(w: np.ndarray) -> np.ndarray:
        (fp, dp), (fu, du) = _sums(p, w), _sums(u, w)
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = du.T @ su / len(u) - prior * (dp.T @ sp) / len(p)
        return -down if negative < 0 else prior * (dp.T @ (sp - 1)) / len(p) + down

    model.weights = _descended(2 * width + 1, slope)
    return model


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", TEXT_BYTES):
        values = [features(x) for x in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("positive"), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "positive", "values"])


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """The model of docs (doc_id, text) and labels (doc_id, quality), held-out rows left aside.

    Only rows labelled 1 are used, nulls and other qualities are not; without them every text scores one half."""
    known = labels.select("doc_id", "quality").filter(~held_out(F.col("doc_id")) & (F.col("quality") == 1))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    trusted = known.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    trusted = trusted.orderBy(*order).limit(max_positive).withColumn("positive", F.lit(True))
    web = docs.select("doc_id").filter(~held_out(F.col("doc_id"))).distinct().orderBy(*order).limit(max_unlabelled).withColumn("positive", F.lit(False))
    picked = F.broadcast(trusted.unionByName(web))  # at most max_positive + max_unlabelled ids
    out = "doc_id long, positive boolean, values array<double>"
    rows = scratch(docs.select("doc_id", "text").join(picked, "doc_id").mapInArrow(_rows, out), "quality-sample")
    values: dict[bool, list] = {}
    for kind, most in ((True, max_positive), (False, max_unlabelled)):
        # a repeated doc_id brings more rows than ids: the bound is one of rows
        found = rows.filter(F.col("positive") == kind).orderBy(*order, "values").limit(most)
        values[kind] = [r["values"] for r in found.select("values").collect()]
    release(rows)
    # in an order of their own, so that sums don't depend on how tasks end
    positive, unlabelled = (np.array(sorted(values[k]), float).reshape(-1, len(NAMES)) for k in (True, False))
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0), from the whole text alone.

    Null and empty texts get the score of a text without words. Columns of docs with these names are replaced."""
    docs = docs.drop("score", "predicted")
    out = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            scores = _scores(model, batch)
            columns = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, out)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            yield batch.filter(pa.array(_scores(model, batch) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _scores(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    return np.round(model.scores(np.array([features(x) for x in texts(batch)], float).reshape(-1, len(NAMES))), 9)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
