"""Removal of repeated substrings by distributed prefix doubling over a sparse set of positions.

Ranks are tables that Spark sorts: a round takes rows of (rank of a shorter string, name of the bytes it grows by,
least and greatest doc_id), reduces them to classes, drops the classes of one document, and numbers the others in sort
order. That number is the rank that the next round pairs. Positions whose class is unique leave for good.

A round over every position that the steps below leave was measured (README has the figures): rows for
them take nearly ten times the input on disk in one round, so not every position is ranked:

0. Positions. Each window of LENGTH bytes holds one anchor, its least K-byte string by hash; equal windows have equal
   anchors at equal places. Only anchors are ranked at first, about one position in ten. A sieve goes ahead: names of
   anchors that no second row holds are unique strings, whose windows are unique; it keeps every other one. Of what is
   left, most stands in passages much longer than LENGTH. Runs of neighbouring windows, cut by content about every
   hundred bytes, are classed first by their whole bytes: a run that a smaller document holds is far past the
   threshold, and none of its positions is ranked.
1. K/2 to K bytes: the rank at an anchor comes from the pair of strings of half its length, at the anchor and at offset
   K/2.
2. K to past LENGTH: the windows of one anchor stand next to each other and cover a stretch of LENGTH bytes or more. Its
   rank comes from the pair (rank of the anchor, the bytes around it up to the stretch's ends). A stretch that a smaller
   document holds is past the threshold, and all its windows are settled.
3. K to LENGTH: where an anchor's class stands in several stretches, the windows of each stretch's first document are
   ranked one by one, from the pair (rank of the anchor, the bytes up to the window's ends).

Anchors are found once a text: a slice carries the layout of its stretches, and bits a stretch say what the sieve and the
settled runs have left, so that later passes name only those.

The offsets at which strings start and the bytes that aren't ranked yet are named by 64-bit hashes of themselves. Rows
are reduced within a slice (some megabytes of whole documents) before they are sent: a string that a third of all
documents hold is one row a slice, and Spark's partial aggregation makes it one row a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, joined, mix, powers, prefix_hash, release, scratch, texts

LENGTH, K = 50, 32
#: Bytes of text in a slice, the unit of exchange, and in a segment, the unit of NumPy work; names in a shard of the sieve.
SLICE, SEGMENT, SHARD = 2 << 20, 256 << 10, 500_000
NONE = -(1 << 63)
_LOW = np.uint64((1 << 28) - 1)
#: Bits of an anchor's name, apart from those that order anchors, that are all zero where a run begins: one in four.
_CUT = np.uint64(3)
_ONE = np.uint64(1)

SLICES = "slice long, doc_ids array<long>, ends array<long>, text binary, size long, layout binary"


def _slices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Whole documents, some megabytes a row, with the layout of their stretches, which later passes read."""
    number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
    ids: list[int | None] = []
    parts: list[bytes] = []
    size = 0

    def full() -> pa.RecordBatch:
        whole = b"".join(parts)
        ends = np.cumsum([len(x) for x in parts])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([ends], pa.list_(pa.int64())),
                pa.array([pack.compress(whole)]),
                pa.array([len(whole)]),
                pa.array([pack.compress(_layout(segments(parts, length), length))]),
            ],
            names=["slice", "doc_ids", "ends", "text", "size", "layout"],
        )

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            if parts and size + len(text) > SLICE:
                yield full()
                number, ids, parts, size = number + 1, [], [], 0
            ids.append(doc_id)
            parts.append(text)
            size += len(text)
    if parts:
        yield full()


def _paired(*names: np.ndarray) -> np.ndarray:
    """One name for each tuple of names."""
    out = mix(names[-1])
    for name in reversed(names[:-1]):
        out = mix(name + out * np.uint64(0x9E3779B97F4A7C15) + _ONE)
    return out


class Segment:
    """Some documents, or a piece of a long one, with the anchors of their windows: for each the first and last window
    (low, high), the anchor's place (at) and its document.

    stretches, if known, says how many windows each anchor has and how far it stands from the first; else they are found."""

    def __init__(self, parts: list[bytes], docs: list[int], base: int, length: int, stretches: tuple[np.ndarray, np.ndarray] | None = None):
        self.docs, self.base, self.length, self.k = np.array(docs), base, length, min(K, length)
        data, self.offsets = joined(parts)
        self.sums = prefix_hash(data)
        self.down = powers(len(data) + 1)[1]
        if stretches is None:
            self._find_anchors(len(data) - length + 1)
            return
        # documents are at least a window long, and stretches cover all windows of each in turn
        counts, places = (x.astype(np.int64) for x in stretches)
        stop = np.cumsum(counts)
        of = np.arange(len(parts))
        of = np.repeat(of, np.diff(np.append(np.searchsorted(stop - counts, self.offsets[:-1] - of * (length - 1)), len(counts))))
        self.low = stop - counts + of * (length - 1)
        self.high, self.at, self.doc = self.low + counts - 1, self.low + places, self.docs[of]

    def _find_anchors(self, n: int) -> None:
        length, k = self.length, self.k
        self.low = self.high = self.at = self.doc = np.zeros(0, np.int64)
        if n <= 0:
            return
        # the order of anchors is that of the upper bits, of equal ones the left first; the lower bits say where
        least = self.sums[k:] - self.sums[:-k]
        least *= self.down[: len(least)]
        least &= ~_LOW
        least |= np.arange(len(least), dtype=np.uint64)
        width, span = 1, length - k + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := span - width:
            least = np.minimum(least[:-rest], least[rest:])
        edge = np.ones(n + 1, bool)
        edge[1:-1] = least[1:] != least[:-1]
        # windows that reach into the next document are cut off from those that don't
        ends = self.offsets[1:-1]
        for cut in (ends - length + 1, ends):
            edge[cut[(cut > 0) & (cut < n)]] = True
        starts = np.flatnonzero(edge)
        low, high = starts[:-1], starts[1:] - 1
        doc = np.searchsorted(self.offsets, low, "right") - 1
        own = low + length <= self.offsets[doc + 1]
        self.low, self.high, self.doc = low[own], high[own], self.docs[doc[own]]
        self.at = (least[self.low] & _LOW).astype(np.int64)

    @cached_property
    def keys(self) -> np.ndarray:
        """The anchors' names."""
        return mix((self.sums[self.at + self.k] - self.sums[self.at]) * self.down[self.at])

    def name(self, at: np.ndarray, size) -> np.ndarray:
        """Names of the stretches of size bytes at some places."""
        return mix((self.sums[at + size] - self.sums[at]) * self.down[at])

    def around(self, low: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names of the bytes from low to stop without the anchor at at, and of the anchor's place among them."""
        return _paired(self.name(low, at - low), self.name(at + self.k, stop - at - self.k), (at - low).astype(np.uint64))

    def anchored(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pair of half anchors of some stretches, and the name of the bytes around the anchor."""
        at, half = self.at[which], (self.k + 1) // 2
        return self.name(at, half), self.name(at + self.k - half, half), self.around(self.low[which], at, self.high[which] + self.length)

    def runs(self) -> np.ndarray:
        """Whether a run of stretches next to each other begins at each stretch."""
        new = np.ones(len(self.low), bool)
        new[1:] = (self.doc[1:] != self.doc[:-1]) | (self.low[1:] != self.high[:-1] + 1) | (self.keys[1:] & _CUT == 0)
        return new

    def held_runs(self, new: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs that begin at new, those all of whose stretches are kept: the first stretch of each, how many they
        are, and the name of the run's bytes."""
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(new)))
        whole = np.logical_and.reduceat(kept, first) if len(first) else np.zeros(0, bool)
        first, counts = first[whole], counts[whole]
        low, stop = self.low[first], self.high[first + counts - 1] + self.length
        return first, counts, _paired(self.name(low, stop - low), (stop - low).astype(np.uint64))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of some stretches, by start and number of the stretch."""
        counts = self.high[which] - self.low[which] + 1
        of = np.repeat(which, counts)
        return _spread(self.low[which], counts), of


def _pieces(parts: list[bytes], length: int) -> Iterator[tuple[list[bytes], list[int], int]]:
    """Documents by segments; a longer one in pieces that overlap by a window less one byte, so that each window is in
    one of them."""
    held: list[int] = []
    size = 0
    for i, part in enumerate([*parts, None]):
        if held and (part is None or size + len(part) > SEGMENT):
            yield [parts[j] for j in held], held, 0
            held, size = [], 0
        if part is None or len(part) < length:
            continue
        if len(part) > SEGMENT:
            for base in range(0, len(part) - length + 1, SEGMENT):
                yield [part[base : base + SEGMENT + length - 1]], [i], base
        else:
            held.append(i)
            size += len(part)


def segments(parts: list[bytes], length: int, layout: bytes | None = None) -> Iterator[Segment]:
    """Documents in segments, by their layout if it is known."""
    if layout is None:
        yield from (Segment(*piece, length) for piece in _pieces(parts, length))
        return
    counts, places = np.frombuffer(layout, _width(length)).reshape(2, -1)
    ends, begin, windows = np.cumsum(counts, dtype=np.int64), 0, 0
    for piece in _pieces(parts, length):
        windows += sum(map(len, piece[0])) - len(piece[0]) * (length - 1)
        stop = int(np.searchsorted(ends, windows)) + 1
        yield Segment(*piece, length, (counts[begin:stop], places[begin:stop]))
        begin = stop


def _width(length: int) -> type:
    """A number that holds any count or place within a window."""
    return np.uint8 if length < 256 else np.uint32


def _layout(found: Iterator[Segment], length: int) -> bytes:
    """The windows of each stretch and the place of its anchor, segment by segment."""
    counts, places = _gathered([(s.high - s.low + 1, s.at - s.low) for s in found], (np.int64, np.int64))
    return np.stack([counts, places]).astype(_width(length)).tobytes()


def _opened(row: dict, length: int) -> tuple[list[bytes], np.ndarray, Iterator[Segment]]:
    """A slice's documents, their numbers, and its segments."""
    unpack = zstandard.ZstdDecompressor()
    whole = unpack.decompress(row["text"], max_output_size=max(row["size"], 1)) if row["size"] else b""
    parts = [whole[a:b] for a, b in zip([0, *row["ends"]], row["ends"], strict=False)]
    ids = np.array([NONE if x is None else x for x in row["doc_ids"]], np.int64)
    return parts, ids, segments(parts, length, unpack.decompress(row["layout"]))


def _bits(parts: list[np.ndarray]) -> bytes:
    return np.packbits(np.concatenate([np.zeros(0, bool), *parts])).tobytes()


class _Marks:
    """A bit for each stretch of a slice, read segment by segment."""

    def __init__(self, column: pa.ChunkedArray):
        self.bits, self.at = np.unpackbits(np.frombuffer(column.drop_null()[0].as_py(), np.uint8)).astype(bool), 0

    def of(self, s: Segment) -> np.ndarray:
        self.at += len(s.low)
        return self.bits[self.at - len(s.low) : self.at]


def _first(table: pa.Table) -> dict:
    return table.slice(0, 1).to_pylist()[0]


def _grouped(key: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, the place of one row of each, and their least and greatest document."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    if not len(starts):
        return key, order, docs, docs
    return key[order[starts]], order[starts], np.minimum.reduceat(docs[order], starts), np.maximum.reduceat(docs[order], starts)


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as counted."""
    return np.arange(counts.sum()) + np.repeat(first - np.cumsum(counts) + counts, counts)


def _find(names: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each name among ascending ones, or -1."""
    if not len(among):
        return np.full(len(names), -1, np.int64)
    at = np.minimum(np.searchsorted(among, names), len(among) - 1)
    return np.where(among[at] == names, at, -1)


def _gathered(found: list[tuple[np.ndarray, ...]], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in enumerate(kinds)]


# --- the sieve

ASKED = "shard int, slice long, keys binary, several binary"
HELD = "slice long, shard int, n int, held binary"


def _asked(batches: Iterator[pa.RecordBatch], length: int, shards: int) -> Iterator[pa.RecordBatch]:
    """A slice's distinct anchors as one row a shard: the lower halves of their names, ascending, and as bits whether
    two of its documents hold them."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = _first(pa.Table.from_batches([batch.slice(i, 1)]))
            _, _, found = _opened(row, length)
            keys, docs = _gathered([(s.keys, s.doc) for s in found], (np.uint64, np.int64))
            names, _, low, high = _grouped(keys, docs)
            shard = ((names >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            used, begin = np.unique(shard, return_index=True)
            cuts = list(zip(begin.tolist(), [*begin.tolist()[1:], len(names)], strict=True))
            lower, several = names.astype(np.uint32), low < high
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()),
                    pa.array([row["slice"]] * len(used), pa.int64()),
                    pa.array([lower[a:b].tobytes() for a, b in cuts], pa.binary()),
                    pa.array([np.packbits(several[a:b]).tobytes() for a, b in cuts], pa.binary()),
                ],
                names=["shard", "slice", "keys", "several"],
            )


def _answered(table: pa.Table) -> pa.Table:
    """For each row asked, as bits, which of its anchors another document may hold. Names that agree in the shard and
    the lower half pass too: the ranks tell them apart."""
    blobs = table.column("keys").to_pylist()
    counts = [len(x) // 4 for x in blobs]
    keys = np.frombuffer(b"".join(blobs), np.uint32)
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("several").to_pylist(), counts, strict=True)]).astype(bool)
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    held = several
    held[order[same[1:] | same[:-1]]] = True
    ends = np.cumsum([0, *counts])
    bits = [np.packbits(held[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"slice": table.column("slice"), "shard": table.column("shard"), "n": pa.array(counts, pa.int32()), "held": pa.array(bits, pa.binary())})


# --- the rounds

#: Beside its rows, a pass over a slice gives one row of bits for its stretches: kept by the sieve, beginning a run; then
#: left to the ranks, in a settled run.
RUNS = "slice long, a long, low long, high long, kept binary, begins binary"
ANCHORS = "slice long, a long, b long, around long, low long, high long, open binary, gone binary"
WINDOWS = "slice long, rank long, around long, low long, high long"
#: Kinds of rows that come back: a stretch that is settled; one whose first document's windows are ranked; a window.
SETTLED, OPEN, WINDOW = 0, 1, 2


def _table(number: int, columns: list[np.ndarray], schema: str, *marks: bytes) -> pa.Table:
    """Rows of a slice, and one row more with its marks if there are any."""
    names = [x.split()[0] for x in schema.split(", ")]
    rows = pa.table([pa.array(np.full(len(columns[0]), number)), *(pa.array(c.view(np.int64)) for c in columns)], names[: 1 + len(columns)])
    if not marks:
        return rows
    bits = pa.table([pa.array([number]), *(pa.array([m], pa.binary()) for m in marks)], ["slice", *names[1 + len(columns) :]])
    return pa.concat_tables([rows, bits], promote_options="default")


def _sieved(answers: pa.Table, keys: np.ndarray) -> np.ndarray:
    """Which of a slice's anchors the sieve has kept."""
    bits, counts = answers.column("held").to_pylist(), answers.column("n").to_pylist()
    parts = [np.unpackbits(np.frombuffer(bits[i], np.uint8), count=counts[i]) for i in np.argsort(answers.column("shard").to_numpy())]
    held = np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    if len(held) != np.count_nonzero(new):
        raise ValueError("the sieve's answer is not that of this slice")
    kept = np.empty(len(keys), bool)
    kept[order] = held[np.cumsum(new) - 1]
    return kept


def _runs(one: pa.Table, answers: pa.Table, length: int) -> pa.Table:
    """The runs of a slice all of whose anchors the sieve has kept, each once."""
    row = _first(one)
    _, ids, found = _opened(row, length)
    whole = list(found)
    kept = _sieved(answers, _gathered([(s.keys,) for s in whole], (np.uint64,))[0])
    names, begins, at = [], [], 0
    for s in whole:
        new = s.runs()
        first, _, name = s.held_runs(new, kept[at : at + len(new)])
        names.append((name, ids[s.doc[first]]))
        begins.append(new)
        at += len(new)
    name, _, low, high = _grouped(*_gathered(names, (np.uint64, np.int64)))
    return _table(row["slice"], [name, low, high], RUNS, _bits([kept]), _bits(begins))


def _anchors(one: pa.Table, back: pa.Table, length: int) -> pa.Table:
    """The anchors of a slice that the sieve has kept and no settled run holds, with what is around them; each
    combination once."""
    row = _first(one)
    _, ids, whole = _opened(row, length)
    kept, begins = _Marks(back.column("kept")), _Marks(back.column("begins"))
    settled = _Settled(back.filter(pc.is_null(back.column("kept"))))
    found, left, over = [], [], []
    for s in whole:
        held = kept.of(s)
        first, counts, names = s.held_runs(begins.of(s), held)
        seen = settled.seen(names, ids[s.doc[first]])
        gone = np.zeros(len(held), bool)
        gone[_spread(first[seen], counts[seen])] = True
        which = np.flatnonzero(held & ~gone)
        found.append((*s.anchored(which), ids[s.doc[which]]))
        left.append(held & ~gone)
        over.append(gone)
    a, b, around, docs = _gathered(found, (np.uint64, np.uint64, np.uint64, np.int64))
    _, at, low, high = _grouped(_paired(a, b, around), docs)
    return _table(row["slice"], [a[at], b[at], around[at], low, high], ANCHORS, _bits(left), _bits(over))


class _Settled:
    """Names (column a) with the least document that holds them."""

    def __init__(self, back: pa.Table):
        names = np.ascontiguousarray(back.column("a").to_numpy()).view(np.uint64)
        order = np.argsort(names)
        self.names, self.least = names[order], back.column("least").to_numpy()[order]

    def seen(self, names: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether a smaller document holds each name."""
        if not len(self.names):
            return np.zeros(len(names), bool)
        at = _find(names, self.names)
        return (at >= 0) & (self.least[at] < own)


class _Back:
    """What came back to a slice: stretches and windows by ascending name, and the marks of its stretches."""

    def __init__(self, back: pa.Table):
        self.open, self.gone = _Marks(back.column("open")), _Marks(back.column("gone"))
        back = back.filter(pc.is_valid(back.column("kind")))
        values = {c: back.column(c).to_numpy() for c in ("rank", "least", "kind")}
        a, b, around, rank = (np.ascontiguousarray(back.column(c).to_numpy()).view(np.uint64) for c in ("a", "b", "around", "rank"))
        window = values["kind"] == WINDOW
        names = np.where(window, _paired(rank, around), _paired(a, b, around))
        order = np.argsort(names)
        of_window, of_stretch = order[window[order]], order[~window[order]]
        self.windows, self.window_least = names[of_window], values["least"][of_window]
        self.names, self.least, self.kind, self.rank = names[of_stretch], values["least"][of_stretch], values["kind"][of_stretch], rank[of_stretch]

    def firsts(self, s: Segment, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the next segment's stretches whether a smaller document holds them; the windows, by start and number of the
        stretch, of those that are open and here first; and the ranks of these windows' stretches."""
        seen, which = self.gone.of(s).copy(), np.flatnonzero(self.open.of(s))
        at = _find(_paired(*s.anchored(which)), self.names)
        known, at = which[at >= 0], at[at >= 0]
        own = ids[s.doc[known]]
        seen[known[self.least[at] < own]] = True
        first = (self.kind[at] == OPEN) & (self.least[at] == own)
        start, of = s.windows(known[first])
        ranks = np.repeat(self.rank[at[first]], s.high[known[first]] - s.low[known[first]] + 1)
        return seen, start, of, ranks

    def hit(self, names: np.ndarray, own: np.ndarray) -> np.ndarray:
        near = _find(names, self.windows)
        return np.flatnonzero((near >= 0) & (self.window_least[near] < own)) if len(self.windows) else np.zeros(0, np.int64)


def _windows(one: pa.Table, back: pa.Table, length: int) -> pa.Table:
    """The windows of the stretches that are open and here first, each combination once."""
    row, held, found = _first(one), _Back(back), []
    _, ids, whole = _opened(row, length)
    for s in whole:
        _, start, of, ranks = held.firsts(s, ids)
        found.append((ranks, s.around(start, s.at[of], start + length), ids[s.doc[of]]))
    rank, around, docs = _gathered(found, (np.uint64, np.uint64, np.int64))
    _, at, low, high = _grouped(_paired(rank, around), docs)
    return _table(row["slice"], [rank[at], around[at], low, high], WINDOWS)


def _cut(one: pa.Table, back: pa.Table, length: int, keep_text: bool) -> pa.Table:
    row, held = _first(one), _Back(back)
    parts, ids, whole = _opened(row, length)
    covered: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for s in whole:
        seen, start, of, ranks = held.firsts(s, ids)
        hit = held.hit(_paired(ranks, s.around(start, s.at[of], start + length)), ids[s.doc[of]])
        # neighbours that are seen are one stretch of bytes
        joint = seen[1:] & seen[:-1] & (s.doc[1:] == s.doc[:-1])
        first, last = seen.copy(), seen.copy()
        first[1:] &= ~joint
        last[:-1] &= ~joint
        low = np.concatenate([s.low[first], start[hit]])
        high = np.concatenate([s.high[last], start[hit]]) + length
        doc = np.concatenate([s.doc[first], s.doc[of[hit]]])
        shift = s.base - s.offsets[np.searchsorted(s.docs, doc)]
        order = np.argsort(doc, kind="stable")
        doc, low, high = doc[order], (low + shift)[order], (high + shift)[order]
        for i in np.unique(doc).tolist():
            a, b = np.searchsorted(doc, [i, i + 1])
            covered.setdefault(i, []).append((low[a:b], high[a:b]))
    return pa.Table.from_batches([_emit(row["doc_ids"], parts, covered, keep_text)])


def _emit(ids: list, parts: list[bytes], covered: dict, keep_text: bool) -> pa.RecordBatch:
    rows = []
    for i, (doc_id, part) in enumerate(zip(ids, parts, strict=True)):
        removed = spans = 0
        if i in covered:
            steps = np.zeros(len(part) + 1, np.int64)
            for low, high in covered[i]:
                np.add.at(steps, low, 1)
                np.add.at(steps, high, -1)
            gone = np.cumsum(steps[:-1]) > 0
            removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            kept = np.frombuffer(part, np.uint8)[~gone].tobytes()
        else:
            kept = part
        rows.append((doc_id, len(part), removed, spans, hashlib.sha256(kept).hexdigest(), kept))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    n = 6 if keep_text else 5
    return pa.RecordBatch.from_arrays(columns[:n], names=names[:n])


def _classes(rows: DataFrame, *pair: str, **more: Column) -> DataFrame:
    """The classes of a pair of names that several documents hold: the least, and how many rows ask."""
    sums = F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("n")
    return rows.groupBy(*pair).agg(*sums, *(c.alias(name) for name, c in more.items())).filter("least < most").drop("most")


def _ranked(classes: DataFrame, *pair: str) -> DataFrame:
    """Classes numbered in the order of their pairs; a number is the partition's and the place in it, so it needs no
    pass of its own, and a task that runs again gives the same."""
    ordered = classes.repartitionByRange(*pair).sortWithinPartitions(*pair)
    return scratch(ordered.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary) for each row of docs.

    Each byte goes that is covered by a string of length bytes (UTF-8) which also starts in a row with a smaller doc_id,
    judged on the input. Null text is empty; texts under length bytes stay; rows that repeat a doc_id don't judge each
    other; a null doc_id is smaller than any other; other columns are not read; no rows give no rows."""
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    table = scratch(docs.select("doc_id", "text").mapInArrow(lambda it: _slices(it, length), SLICES), "slices")
    total = table.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total * 2 // (length - min(K, length) + 2) // SHARD))

    def with_slices(rows: DataFrame, run, schema: str) -> DataFrame:
        return table.groupBy("slice").cogroup(rows.groupBy("slice")).applyInArrow(run, schema)

    held = table.mapInArrow(lambda it: _asked(it, length, shards), ASKED).groupBy("shard").applyInArrow(_answered, HELD)
    held = scratch(held, "sieve")
    both = scratch(with_slices(held, lambda one, answers: _runs(one, answers, length), RUNS), "runs")
    release(held)
    rows, marks = both.filter("kept IS NULL").drop("kept", "begins"), both.filter("kept IS NOT NULL").select("slice", "kept", "begins")
    settled = join_hot(rows, scratch(_classes(rows, "a"), "run-classes"), ["a"], "n", "slice").filter("least < high")
    settled = scratch(settled.select("slice", "a", "least"), "settled-runs").unionByName(marks, allowMissingColumns=True)
    anchors = scratch(with_slices(settled, lambda one, back: _anchors(one, back, length), ANCHORS), "anchors")
    release(settled)
    rows, marks = anchors.filter("open IS NULL").drop("open", "gone"), anchors.filter("open IS NOT NULL").select("slice", "open", "gone")
    # K/2 to K bytes
    ranks = _ranked(_classes(rows, "a", "b", split=F.min("around") != F.max("around")), "a", "b")
    known = scratch(join_hot(rows, ranks, ["a", "b"], "n", "slice"), "known")
    marks = scratch(marks, "marks")
    release(anchors)
    # K bytes to a stretch: of a class with one stretch, its least document holds that
    single = known.filter("NOT split").select("slice", "a", "b", "around", "rank", "least", F.lit(SETTLED).cast("byte").alias("kind"))
    several = known.filter("split").drop("least", "split")
    least = scratch(several.groupBy("rank", "around").agg(F.min("low").alias("least"), F.count("*").alias("n")), "stretches")
    several = join_hot(several, least, ["rank", "around"], "n", "slice").select("slice", "a", "b", "around", "rank", "least", F.lit(OPEN).cast("byte").alias("kind"))
    stretches = scratch(single.unionByName(several), "stretches-of-slices")
    for done in (ranks, least, known):
        release(done)
    # K bytes to length, window by window
    opened = stretches.filter(F.col("kind") == OPEN).unionByName(marks, allowMissingColumns=True)
    rows = scratch(with_slices(opened, lambda one, back: _windows(one, back, length), WINDOWS), "windows")
    repeated = scratch(_classes(rows, "rank", "around"), "window-classes")
    none = F.lit(0).cast("long")
    found = join_hot(rows, repeated, ["rank", "around"], "n", "slice").filter("least < high")
    found = scratch(found.select("slice", none.alias("a"), none.alias("b"), "around", "rank", "least", F.lit(WINDOW).cast("byte").alias("kind")), "windows-of-slices")
    release(rows)
    back = stretches.unionByName(found).unionByName(marks, allowMissingColumns=True)
    return with_slices(back, lambda one, back: _cut(one, back, length, keep_text), out)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
