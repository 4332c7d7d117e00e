"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to RATE of its length in errors (bytes put in, left out or changed). Cut into
error-budget-plus-one pieces, at least one piece occurs unchanged in any such occurrence, so exact piece hits over
whole texts find every candidate place. The same holds for halves: of k pieces with fewer than k errors, one half of
h pieces has fewer than h. A hit is therefore verified upwards, from the two pieces around it to the whole item, each
time with Myers' bit-parallel edit distance, and most hits by chance end at the first step.

Texts and items are compared in a plain form: A-Z in lower case, each run of ASCII characters other than letters and
digits one space, and one space before and after. The spaces around an item count as bytes of it, so a short item, which
has no errors to spend, is found as whole words only; from ten bytes on each tenth byte is an error more.

Items go to the tasks in blocks of bounded size, a pass over the documents for each block: this is made for benchmarks
of some hundred megabytes at most, against documents of any size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts

#: Errors for each byte of an item.
RATE = 0.1
#: Bytes of text that are looked at together; a longer text stays whole, alone.
TEXT_BYTES = 4 << 20
#: Bytes of items that a task holds at once.
BLOCK_BYTES = 4 << 20
_PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def plain(text: bytes) -> bytes:
    """The plain form; empty without a letter, digit or other character."""
    return b" ".join([b"", *found, b""]) if (found := text.translate(_PLAIN).split()) else b""


def budget(size: int) -> int:
    """Errors that an item of so many bytes in plain form may have."""
    return int(RATE * size)


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """error-budget-plus-one pieces with their offsets, as even as can be."""
    n = budget(len(item)) + 1
    edges = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def climbs(item: bytes) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """For each piece its offset and end, and the (start, end, errors) of the stretches that hold it, by halving, from
    the smallest to the one below the whole item."""
    own = pieces(item)
    edges = [a for a, _ in own] + [len(item)]
    out: list[tuple[int, int, list]] = [(a, a + len(x), []) for a, x in own]

    def halve(low: int, high: int, whole: bool) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        halve(low, middle, False)
        halve(middle, high, False)
        if not whole:
            for k in range(low, high):
                out[k][2].append((edges[low], edges[high], high - low - 1))

    halve(0, len(own), True)
    return out


def bits(item: bytes) -> dict[int, int]:
    """For each byte value the places of item that hold it, as bits."""
    peq: dict[int, int] = {}
    for k, byte in enumerate(item):
        peq[byte] = peq.get(byte, 0) | 1 << k
    return peq


def nearest(peq: dict[int, int], size: int, text: bytes, most: int, first: bool = False) -> tuple[int, int] | None:
    """The least edit distance of an item, given as bits, to any stretch of text and the end of the first such stretch,
    or None if it is above most; with first, the first distance that isn't above most.

    Myers' algorithm with one whole number for all rows; the top row is free, so a stretch may start anywhere."""
    full, top = (1 << size) - 1, 1 << size - 1
    plus, minus, score = full, 0, size
    best, at = most + 1, 0
    for j, byte in enumerate(text, 1):
        eq = peq.get(byte, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(xh | plus)), plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(xv | up)), up & xv
        if score < best:
            best, at = score, j
            if first:
                break
    return (best, at) if best <= most else None


class Matcher:
    """The piece automaton of some items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = [(k, x) for k, x in ((k, plain(x)) for k, x in items) if x]
        self.automaton = ahocorasick.Automaton()
        self.bits: dict[tuple[int, int, int], dict[int, int]] = {}
        places: dict[bytes, list[tuple]] = {}
        for number, (_, item) in enumerate(self.items):
            for low, high, steps in climbs(item):
                places.setdefault(item[low:high], []).append((number, low, high, steps))
        for piece, at in places.items():
            self.automaton.add_word(piece.decode("latin-1"), at)
        self.automaton.make_automaton()

    def _bits(self, number: int, low: int, high: int) -> dict[int, int]:
        key = number, low, high
        if key not in self.bits:
            self.bits[key] = bits(self.items[number][1][low:high])
        return self.bits[key]

    def _climb(self, text: bytes, start: int, number: int, steps: list[tuple[int, int, int]]) -> bool:
        """Whether all stretches around a hit, of an item that would start at start, occur with their errors."""
        for low, high, most in steps:
            window = text[max(start + low - most, 0) : start + high + most]
            if not nearest(self._bits(number, low, high), high - low, window, most, True):
                return False
        return True

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the plain text) for each place where an item occurs; places whose windows touch
        are one, with the least distance."""
        if not self.items:
            return []
        text = plain(text)
        seen: dict[int, dict[int, bool]] = {}
        for end, places in self.automaton.iter(text.decode("latin-1")):
            for number, _, high, steps in places:
                start, known = end + 1 - high, seen.setdefault(number, {})
                if not known.get(start):
                    known[start] = self._climb(text, start, number, steps)
        found = []
        for number, known in seen.items():
            key, item = self.items[number]
            size, most = len(item), budget(len(item))
            run: list[int] = []
            for start in [*sorted(k for k, good in known.items() if good), None]:
                if run and (start is None or start - run[-1] > most):
                    low, high = max(run[0] - most, 0), run[-1] + size + most
                    if hit := nearest(self._bits(number, 0, size), size, text[low:high], most):
                        found.append((key, hit[0], low + hit[1]))
                    run = []
                if start is not None:
                    run.append(start)
        return found


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in blocks of at most BLOCK_BYTES, in item_id order: one block is fetched at once, more are streamed to the
    driver a partition at a time."""
    block, size = [], 0
    held = items.select("item_id", "text").filter(F.length("text") > 0)
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = held.orderBy("item_id", "text")
    for row in ordered.collect() if total <= BLOCK_BYTES else ordered.toLocalIterator():
        text = row["text"].encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    yield block


_built: dict[str, Matcher] = {}


def _matcher(name: str, held: Broadcast) -> Matcher:
    """The automaton of a block, built once in a worker."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(held.value)
    return _built[name]


FOUND = "doc_id long, item_id long, distance int, n_places int"


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance (the least) and n_places for each row of docs and item that occurs in it.

    Null or empty texts and items match nothing; rows that repeat a doc_id are judged each by itself; an empty table of
    items or documents gives no rows."""
    out = None
    for block in _blocks(items):
        held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held, name: str = name) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, held)
            for batch in slices(batches, "text", TEXT_BYTES):
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                    best: dict[int, tuple[int, int]] = {}
                    for key, distance, _ in matcher.matches(text):
                        least, n = best.get(key, (distance, 0))
                        best[key] = (min(least, distance), n + 1)
                    rows += [(doc_id, k, d, n) for k, (d, n) in best.items()]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "distance", "n_places"])

        part = docs.select("doc_id", "text").mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, in which no item occurs.

    Null or empty texts hold no item and stay, as do all rows where items are null, empty or none; rows that repeat a
    doc_id are judged each by itself."""
    for block in _blocks(items):
        held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held, name: str = name) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, held)
            for batch in slices(batches, "text", TEXT_BYTES):
                kept = [not matcher.matches(text) for text in texts(batch)]
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
