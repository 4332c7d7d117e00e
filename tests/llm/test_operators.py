"""Each operator against a plain rendering of its contract, edge cases included."""

import hashlib
import json
import math
import re
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, license_scan, line_dedup, media, mixing, near_dup, quality, suffix_dedup, token_counts, token_output
from tidemark.llm.common import scratch_path
from tidemark.llm.tokens import TOKENIZER, TokenCache, load

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def bag(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


# --- 1: line dedup


@pytest.mark.parametrize("array_bytes", [64 << 20, 0])
def test_lines(docs, array_bytes):
    rows = rows_of(docs)
    key = lambda line: ascii_lower(line.strip(" \t\n\r\x0b\x0c"))
    held = defaultdict(set)
    for n, (doc_id, text) in enumerate(rows):
        for line in text.split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(n)
    order = lambda k: -(1 << 63) if k is None else k
    keeper = {k: max(order(rows[n][0]) for n in v) for k, v in held.items() if len(v) >= 3}
    want = []
    for doc_id, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if keeper.get(key(x), order(doc_id)) == order(doc_id)]
        want.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = bag(line_dedup.dedup_lines(docs, array_bytes=array_bytes), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_perfect_hash_finds_every_key_in_its_own_slot():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    table = line_dedup.PerfectHash(keys)
    assert sorted(table.slots(keys)) == list(range(len(keys)))


# --- 2: token counts


def test_rollup_is_additive_and_idempotent(spark, docs):
    counted = token_counts.token_counts(docs)
    want = defaultdict(lambda: [0, 0])
    tokenizer = load(TOKENIZER)
    for r in docs.collect():
        cell = want[r["source"], r["lang"], "v1"]
        cell[0] += 1
        cell[1] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", token_counts.signed(counted, 1, "v1"))
    full = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in rollup.totals().collect()}
    assert full == dict(want)
    assert not rollup.commit("one", token_counts.signed(counted, 1, "v1"))
    rollup.commit("grow", token_counts.revised(counted, counted.withColumn("n_tokens", F.col("n_tokens") + 1), "v1"))
    rollup.compact()
    assert not rollup.commit("grow", token_counts.signed(counted, 1, "v1"))
    grown = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in rollup.totals().collect()}
    assert grown == {k: [a, b + a] for k, (a, b) in want.items()}
    rollup.commit("gone", token_counts.signed(counted.withColumn("n_tokens", F.col("n_tokens") + 1), -1, "v1"))
    assert rollup.totals().count() == 0


def test_a_batch_committed_while_others_are_folded_counts_once(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, scratch_path(spark, "rollup"))
    row = lambda n: spark.createDataFrame([("a", "en", "v", 1, n)], token_counts.SCHEMA)
    rollup.commit("one", row(10))
    sums = rollup._sums

    def meanwhile(*args):
        monkeypatch.setattr(rollup, "_sums", sums)
        rollup.commit("two", row(5))
        return sums(*args)

    monkeypatch.setattr(rollup, "_sums", meanwhile)
    rollup.compact()
    assert bag(rollup.totals(), "n_docs", "n_tokens") == [(2, 15)]
    rollup.compact()
    assert bag(rollup.totals(), "n_docs", "n_tokens") == [(2, 15)] and len(rollup.names("folds")) == 1
    assert not rollup.commit("one", row(10)) and not rollup.commit("two", row(5))


def test_token_counts_query(spark, docs, empty, tmp_path):
    """The query's three batches against a plain count of one copy of each text."""
    tokenizer = load(TOKENIZER)
    for name, table in (("some", docs), ("none", empty), ("twice", docs.unionByName(docs))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        kept = {}
        for r in table.collect():
            key = (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["lang"] or "")
            if (r["text"] or "") not in kept or key < kept[r["text"] or ""][0]:
                kept[r["text"] or ""] = key, r
        want = defaultdict(lambda: [0, 0])
        for text, (_, r) in kept.items():
            cell = want[r["source"], r["lang"]]
            cell[0] += 1
            cell[1] += len(tokenizer.encode(text, add_special_tokens=False).ids)
        got = {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"]] for r in token_counts.op2_token_counts(spark, f"{tmp_path}/{name}").collect()}
        assert got == dict(want)


# --- 3: token output


def test_store_round_trip(spark, docs):
    path = scratch_path(spark, "store")
    token_output.write_store(docs, path, shards=3, block_bytes=4000)
    tokenizer = load(TOKENIZER)
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert bag(token_output.read_store(spark, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_output.read_document(spark, path, 12) == [*tokenizer.encode(dict(rows)[12], add_special_tokens=False).ids, 0]
    assert token_output.read_document(spark, path, 12345) is None
    small = scratch_path(spark, "store")
    token_output.write_store(docs, small, shards=3, block_bytes=200)
    near = token_output.blocks_of(spark, small, 12)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = near.select("shard", "block")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(first_id,12)" in plan and "GreaterThanOrEqual(last_id,12)" in plan and "data" not in plan.split("ReadSchema:")[1]
    assert near.count() == 1 < spark.read.parquet(f"{small}/frames").count()
    for doc_id in (0, 3, 7, 12, 900):
        of_id = [[*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in rows if d == doc_id]
        assert token_output.read_document(spark, small, doc_id) in of_id


def test_words_are_turned_into_letters_in_one_go():
    """Ids of many words by the model alone are those of the whole tokenizer, in order."""
    cache = TokenCache()
    words = ["Straße", " naïve", "a", " Ġ", "слово", " 漢字", "ĊĊ", " the", "unbelievably", " ÿ", "İstanbul"]
    want = [cache.tokenizer.encode(x, add_special_tokens=False).ids for x in words]
    assert [ids for ids, _ in zip(cache._words(words), words, strict=True)] == want
    assert cache._ids([*words, "a1", " x,"]) == [np.array(x, "<u4").tobytes() for x in want + [cache.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a1", " x,")]]
    assert cache._ids([]) == [] and cache._ids(["7"]) == [np.array(cache.tokenizer.encode("7").ids, "<u4").tobytes()]


# --- 4: mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        spread = sum(weight[s] for s in names if s not in capped)
        share = {s: left * weight[s] / spread for s in names if s not in capped}
        over = {s for s, v in share.items() if v > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def test_mixing_targets_and_copies(docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix"]
    rows = mixed.select("doc_id", "text", "source", "mix.*").collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += r["size"]
    want = plain_targets(sizes)
    assert all(abs(r["target"] - want[r["source"]]) < 1e-5 and r["target"] >= 0 for r in rows)
    for r in rows:
        rate = r["target"] / sizes[r["source"]]
        assert int(rate) <= r["copies"] <= int(rate) + (rate > int(rate))
    assert len(rows) == docs.count()
    again = mixing.mix(docs.repartition(5))
    assert bag(again.select("doc_id", "mix.copies", "text"), "doc_id", "copies", "text") == sorted(((r["doc_id"], r["copies"], r["text"]) for r in rows), key=repr)
    clashing = docs.withColumns({n: F.lit(n) for n in ("copies", "target", "source_size", "_source", "mix", "copy", "key", "c0")})
    several = mixing.repeated(clashing)
    assert several.columns == clashing.columns
    copies = defaultdict(int)
    for r in several.collect():
        assert (r["copies"], r["mix"], r["c0"]) == ("copies", "mix", "c0")
        copies[r["doc_id"], r["text"]] += 1
    want = defaultdict(int)
    for r in rows:
        want[r["doc_id"], r["text"]] += r["copies"]
    assert copies == {k: n for k, n in want.items() if n}


def test_mixing_reaches_targets_on_many_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.pmod("id", F.lit(7))).alias("source"), F.repeat(F.lit("w "), (10 + F.pmod("id", F.lit(13))).cast("int")).alias("text"))
    mixed = mixing.mix(docs).select("source", "mix.*")
    sums = mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert all(abs(r["taken"] - r["t"]) < 0.1 * r["t"] for r in sums)


# --- 5: licence scan


def test_licence_base_places(spark, docs):
    extra = spark.createDataFrame([(5000, "Under CC-BY: cc by, General Public License; ALL  rights\nreserved all rights"), (5001, "cc\xa0by"), (5002, "unless required by applicable law or agreed to in writing, software distributed under the new license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    found, spans = license_scan.scan(every)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {tuple(k.split()): v for k, v in license_scan.BASE.items()}
    want = []
    for doc_id, text in rows_of(every):
        tokens = word.findall(ascii_lower(text))
        at = [(i, v) for p, v in phrases.items() for i in range(len(tokens)) if tuple(tokens[i : i + len(p)]) == p]
        starts = [i for i, _ in at]
        want.append((doc_id, len(tokens), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({v for _, v in at}))))
    assert bag(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in found.collect()}
    assert labels[5002][0] == "apache-2.0" and labels[5002][1] > 0.9
    assert labels[5000][0] == "cc-by,gpl,reserved" and labels[5000][1] == 1.0
    assert spans.filter("doc_id = 5002").count() == 1


def test_licence_labels_of_changed_copies(spark):
    """Of copies of each template with one word in twenty left out, put in or changed, nearly all get its label; texts of
    the same words in another order get none."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for number, (phrase, label) in enumerate(license_scan.TEMPLATES.items()):
        for copy in range(8):
            said = phrase.split()
            for _ in range(max(1, len(said) // 20) if len(said) >= 12 else 0):
                at, kind = int(rng.integers(1, len(said) - 1)), int(rng.integers(0, 3))
                said[at : at + 1] = ([], [said[at], "indeed"], ["other"])[kind]
            doc_id = number * 10 + copy
            want[doc_id] = label
            rows.append((doc_id, f"some words before it. {' '.join(said).capitalize()}, and words after"))
        if len(shuffled := phrase.split()) >= 12:
            rng.shuffle(shuffled)
            rows.append((number * 10 + 9, " ".join(shuffled)))
    found, _ = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = {r["doc_id"]: r["labels"].split(",") for r in found.collect()}
    recall = sum(label in labels[k] for k, label in want.items()) / len(want)
    assert recall > 0.95
    assert not any(set(labels[k]) - {"", "cc-by", "gpl", "reserved"} for k in labels if k % 10 == 9)


def test_scattered_pieces_of_a_template_are_no_licence(spark):
    isc = next(t for t, label in license_scan.TEMPLATES.items() if label == "isc").split()
    scattered = " ".join(" ".join([*isc[k : k + 3], "zz"]) for k in range(0, len(isc), 3))
    whole = next(t for t, label in license_scan.TEMPLATES.items() if label == "zlib" and len(t.split()) > 100)
    changed = whole.split()
    del changed[40]
    changed[10:10] = ["really", "truly"]
    changed[70] = "xx"
    rows = [(1, scattered), (2, f"before {' '.join(changed)} after"), (3, " ".join(reversed(whole.split()))), (4, "x y " * 40 + " ".join(isc) + " z" * 9)]
    found, spans = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in found.collect()}
    assert got[1] == ("", 0.0) and got[2][0] == "zlib" and got[2][1] > 0.9 and got[3] == ("", 0.0) and got[4] == ("isc", 1.0)
    exact = [(r["doc_id"], r["start"]) for r in spans.filter("like = 1").collect()]
    assert (4, 80) in exact


def test_many_licences_in_one_text(spark):
    template = next(t for t, label in license_scan.TEMPLATES.items() if label == "isc")
    text = " ".join([f"{template} and so on"] * 10_000)
    found, spans = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r["labels"] for r in found.collect()] == ["isc"]
    size = len(template.split()) + 3
    starts = {r["start"] for r in spans.filter("label = 'isc' AND like = 1").collect()}
    assert starts >= {k * size for k in range(10_000)}


def test_licence_query_on_empty_null_and_repeated_rows(spark, docs, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    docs.unionByName(docs).write.parquet(f"{tmp_path}/twice/documents.parquet")
    assert license_scan.op5_license_scan(spark, f"{tmp_path}/none").count() == 0
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    once = bag(license_scan.scan(docs)[0], *columns)
    assert bag(license_scan.op5_license_scan(spark, f"{tmp_path}/twice"), *columns) == sorted(once + once, key=repr)


# --- 6: repeated substrings


def plain_removal(rows, size=50):
    order = lambda k: -(1 << 63) if k is None else k
    first = {}
    for doc_id, text in rows:
        data = text.encode()
        for i in range(len(data) - size + 1):
            w = data[i : i + size]
            first[w] = min(first.get(w, 1 << 62), order(doc_id))
    out = []
    for doc_id, text in rows:
        data = text.encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - size + 1):
            if first[data[i : i + size]] < order(doc_id):
                gone[i : i + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs):
    got = suffix_dedup.remove_repeats(docs)
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removal(rows_of(docs))
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_removal_in_long_texts_and_of_passages_in_every_document(spark):
    """A text of several segments, whose repeats lie across their borders; a passage that all documents hold, with other
    bytes around it in each; runs of copies with changes; and the small tables' documents."""
    rng = np.random.default_rng(11)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    passage = " ".join(word(6) for _ in range(20))
    long = " ".join(word(7) for _ in range(150_000))
    assert len(long) > 4 * suffix_dedup.SEGMENT
    rows = [(5, long), (9, long[suffix_dedup.SEGMENT - 400 : suffix_dedup.SEGMENT + 300] + word(80) + long[:60])]
    rows += [(20 + k, word(40) + passage + word(30 + k)) for k in range(60)]
    copy = long[100_000:104_000]
    for k in range(12):
        at = int(rng.integers(0, 3_900))
        rows.append((100 + k, copy[:at] + word(3) + copy[at + 3 :]))
    rows.append((4, "ß" * 30 + passage[:49] + "ü" + passage[60:]))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert bag(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_removal(rows)
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_removal(rows_of(small))
    assert bag(suffix_dedup.remove_repeats(small, keep_text=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(w[2] > 0 for w in want) > 50


def test_windows_of_long_documents_are_each_in_one_segment(monkeypatch):
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 700, dtype=np.uint8))
    whole = suffix_dedup.Segment([text], [0], 0, 50)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 100)
    pieces = list(suffix_dedup.segments([b"short", text, b"z" * 60], 50))
    starts = sorted(int(s.base + x) for s in pieces if s.docs[0] == 1 for x in s.windows(np.arange(len(s.low)))[0])
    assert starts == list(range(651))
    assert sum(len(s.windows(np.arange(len(s.low)))[0]) for s in [whole]) == 651


def test_a_segment_names_all_places_without_looking_each_up(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(300)).encode()
    plain = suffix_dedup.Segment([text], [0], 0, 50)
    want = plain.name(plain.at, plain.k)
    monkeypatch.delattr(suffix_dedup.Segment, "name")
    assert suffix_dedup.Segment([text], [0], 0, 50).keys.tolist() == want.tolist()


def test_anchors_are_found_once_a_text_and_later_passes_read_where_they_are(monkeypatch):
    rng = np.random.default_rng(7)
    long, word = (bytes(rng.integers(97, 100 + x, n, dtype=np.uint8)) for x, n in ((0, 700), (20, 90)))
    parts = [b"", b"short", long, b"a" * 49, b"b" * 50, b"c" * 51 + word, b"ab" * 40, word + b"tail", "\u00fc".encode() * 90]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 200)
    monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": [*range(8), None], "text": [x.decode() for x in parts]})
    for length in (7, 33, 50, 300):
        found = list(suffix_dedup.segments(parts, length))
        (slices,) = suffix_dedup._slices(iter([batch]), length)
        (none,) = suffix_dedup._slices(iter([batch.slice(0, 1)]), length)
        with monkeypatch.context() as m:
            m.delattr(suffix_dedup.Segment, "_find_anchors")
            _, ids, read = suffix_dedup._opened(slices.to_pylist()[0], length)
            for x, y in zip(found, read, strict=True):
                assert x.base == y.base
                assert all(getattr(x, c).tolist() == getattr(y, c).tolist() for c in ("low", "high", "at", "doc", "keys"))
            asked = pa.Table.from_batches(suffix_dedup._asked(iter([slices]), length, 3))
            answers = pa.concat_tables([suffix_dedup._answered(asked.slice(i, 1)) for i in range(asked.num_rows)])
            runs = suffix_dedup._runs(pa.Table.from_batches([slices]), answers, length)
            empty = suffix_dedup._runs(pa.Table.from_batches([none]), answers.slice(0, 0), length)
        assert ids.tolist() == [*range(8), suffix_dedup.NONE]
        assert empty.to_pylist() == [{"slice": 0, "a": None, "low": None, "high": None, "kept": b"", "begins": b""}]
        owners = {}
        for s in found:
            for key, doc in zip(s.keys.tolist(), s.doc.tolist(), strict=True):
                owners.setdefault(key, set()).add(doc)
        want = [len(owners[key]) > 1 for s in found for key in s.keys.tolist()]
        kept = np.unpackbits(np.frombuffer(runs.column("kept")[-1].as_py(), np.uint8), count=len(want))
        assert kept.astype(bool).tolist() == want
        assert any(want) == (length < 90)


# --- 7: similar sets


def plain_classes(rows, percent=80, words=5):
    sets = []
    for _, text in rows:
        w = WORD.findall(ascii_lower(text))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return sorted(((d, len(sets[i]), min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def test_classes(docs):
    assert bag(near_dup.classes(docs), "doc_id", "n_shingles", "component_id") == plain_classes(rows_of(docs))


def test_classes_of_chains_and_large_groups(spark, monkeypatch):
    """Drifting copies, whose ends don't link, in parts smaller than their group."""
    monkeypatch.setattr(near_dup, "PART", 8)
    rows = []
    for chain in range(3):
        words = [f"w{chain}x{i}" for i in range(60)]
        for step in range(40):
            words[(step * 7) % 60] = f"new{chain}x{step}"
            rows.append((chain * 100 + step, " ".join(words)))
    passage = " ".join(f"common{i}" for i in range(30))
    rows += [(1000 + i, passage + " " + " ".join(f"own{i}x{j}" for j in range(60))) for i in range(40)]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert bag(got, "doc_id", "n_shingles", "component_id") == plain_classes(rows)


def largest_join(spark, run):
    """The most rows that any join of the plans that run executes gives."""
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsList().size()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, done = 0, store.executionsList()
    for k in range(first, done.size()):
        number = done.apply(k).executionId()
        nodes, values = store.planGraph(number).allNodes(), store.executionMetrics(number)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def test_a_family_that_does_not_link_meets_by_groups(spark, monkeypatch):
    """Hundreds of near copies, some just below the threshold, in many groups: no join has a row for each set, group and
    token, or more rows than the sets have tokens."""
    monkeypatch.setattr(near_dup, "PART", 16)
    rows, rng = [], np.random.default_rng(5)
    for k in range(240):
        words = [f"w{i}" for i in range(300)]
        for j, place in enumerate(rng.choice(59, 5 if k % 3 else 2, replace=False).tolist()):
            words[5 * place + 2] = f"new{k}x{j}"
        rows.append((k, " ".join(words)))
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    most = largest_join(spark, lambda: got.extend(bag(near_dup.classes(docs), "doc_id", "n_shingles", "component_id")))
    assert got == plain_classes(rows)
    assert 0 < most <= sum(n for _, n, _ in got)


def test_classes_of_near_copies_without_ids(spark):
    """A text with a null doc_id links with its near copies, and carries a chain whose ends don't link."""
    w = [[f"w{k}x{i}" for i in range(60)] for k in range(3)]
    changed = [[*x[:4], "new", *x[5:]] for x in w]
    twice = [[*x[:50], "newer", *x[51:]] for x in changed]
    rows = [(1, w[0]), (None, changed[0]), (2, w[1]), (None, changed[1]), (3, twice[1]), (None, w[2]), (None, changed[2])]
    rows = [(k, " ".join(x)) for k, x in rows]
    want = plain_classes(rows)
    assert {(None, 56, 1), (3, 56, 2)} <= set(want) and (3, 56, 3) in plain_classes([rows[2], rows[4]])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(near_dup.classes(docs), "doc_id", "n_shingles", "component_id") == want
    assert bag(near_dup.keep_one(docs), "doc_id")[:2] == [(1,), (2,)] and near_dup.keep_one(docs).count() == 3


def test_keep_one(docs):
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    rows = rows_of(docs)
    classes = defaultdict(list)
    for place, _, component in plain_classes([(k, text) for k, (_, text) in enumerate(rows)]):
        if WORD.search(rows[place][1]):
            classes[component].append(rows[place][0])
    want = [min(ids, key=lambda x: (x is None, x or 0)) for ids in classes.values()]
    got = [r["doc_id"] for r in kept.collect() if WORD.search(r["text"] or "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_orders_of_grouping_differ_and_do_not_hang_on_places(spark):
    """The least token in an order is that of the same tokens in any array; three orders pick several tokens."""
    rows = [([7, 5, 9, 1, 12, 30, 44],), ([44, 30, 1, 9, 5, 7, 12],), ([2, 44, 30, 1, 9, 5, 7, 12],)]
    found = spark.createDataFrame(rows, "t array<long>").select(*(near_dup._least_by("t", k).alias(f"k{k}") for k in range(3))).collect()
    assert tuple(found[0]) == tuple(found[1]) and len(set(found[0])) == 3
    assert sum(a == b for a, b in zip(found[0], found[2], strict=True)) >= 2


def test_keep_one_of_unlike_texts_under_null_and_repeated_ids(spark):
    """Two classes stay apart where they share their least doc_id, or have none."""
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (1, text["c"]), (7, text["d"]), (7, text["e"]), (8, text["e"] + " tail"), (9, text["f"])]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert bag(kept, "doc_id", "text") == sorted([(None, text["a"]), (None, text["b"]), (1, text["c"]), (7, text["d"]), (7, text["e"]), (9, text["f"])], key=repr)


# --- 8: media


def test_media_round_trip(spark, docs):
    path = scratch_path(spark, "media")
    media.write_media(docs, path)
    got = {}
    for r in media.read_media(spark, path).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    same = {}
    for doc_id, text in rows_of(docs):
        data = text.encode()
        whole = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        match = [r for r in got[doc_id] if r["payload_sha256"] == hashlib.sha256(whole).hexdigest()]
        assert match and match[0]["n_bytes"] == len(data) and match[0]["payload_bytes"] == len(whole) and match[0]["tail_crc32"] == zlib.crc32(whole[-32:])
        assert same.setdefault(text, tuple(match[0])[4:]) == tuple(match[0])[4:]


def test_media_hot_chunks_and_a_base_store(spark, docs, monkeypatch):
    first, second = scratch_path(spark, "media"), scratch_path(spark, "media")
    media.write_media(docs, first)
    media.write_media(docs, second, base=first)
    assert media.chunk_table(spark, second).count() == 0
    monkeypatch.setattr(media, "HOT_REFS", 1)
    monkeypatch.setattr(media, "BROADCAST_BYTES", 0)
    columns = ("doc_id", "payload_sha256", "media_sha256")
    assert bag(media.read_media(spark, second, (first,)), *columns) == bag(media.read_media(spark, first), *columns)


def test_a_missing_chunk_raises(spark, docs):
    whole, broken = scratch_path(spark, "media"), scratch_path(spark, "media")
    media.write_media(docs, whole)
    for part in ("lists", "meta"):
        spark.read.parquet(f"{whole}/{part}").write.parquet(f"{broken}/{part}")
    chunks = media.chunk_table(spark, whole)
    one = chunks.orderBy("digest").first()["digest"]
    chunks.filter(F.col("digest") != F.lit(one)).write.parquet(f"{broken}/chunks")
    with pytest.raises(Exception, match="is missing"):
        media.read_media(spark, broken).collect()


def test_media_query_on_copies_nulls_and_no_rows(spark, docs, empty, tmp_path):
    """op8's own columns against the bytes: equal texts have equal values, features are those of the payload."""
    docs.write.parquet(f"{tmp_path}/some/documents.parquet")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op8_media_chunks(spark, f"{tmp_path}/none").count() == 0
    want = defaultdict(list)
    for doc_id, text in rows_of(docs):
        data = media.payload(text.encode())
        values = np.frombuffer(data, np.uint8).astype(int)
        shares = [int(((values >= 32 * k) & (values < 32 * k + 32)).sum()) * 1000 // len(values) for k in range(8)]
        steps = sum(abs(int(b) - int(a)) for a, b in zip(values, values[1:], strict=False)) // (len(values) - 1)
        want[doc_id].append((len(text.encode()), hashlib.sha256(data).hexdigest(), "-".join(map(str, [*shares, steps]))))
    got = defaultdict(list)
    stored = defaultdict(set)
    for r in media.op8_media_chunks(spark, f"{tmp_path}/some").collect():
        got[r["doc_id"]].append((r["n_bytes"], r["payload_sha256"], r["feature"]))
        stored[r["payload_sha256"]].add((r["media_bytes"], r["media_sha256"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all(len(v) == 1 for v in stored.values())


def test_chunks_move_with_their_content():
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(0, 256, 200_000, dtype=np.uint8))
    a, b = ({media.digest(c) for c in next(media.chunked([x]))} for x in (data, b"shift" + data))
    assert len(a & b) > 0.8 * len(a) and b"".join(next(media.chunked([data]))) == data


# --- 9: decontamination


def test_edits_within_budget(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps for seven days under a tree."
    near = item.replace("lazy", "lazzy").replace("seven", "sevn").upper()
    far = " ".join(item.split()[::2])
    rows = [(1, f"start {item} end"), (2, near), (3, far), (4, None), (5, ""), (None, item), (6, "clean text " * 50)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "no such words anywhere here")], "item_id long, text string")
    got = bag(decontaminate.find(docs, items), "doc_id", "item_id", "distance")
    assert got == sorted([(1, 7, 0), (2, 7, 2), (None, 7, 0)], key=repr)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == [3, 4, 5, 6]
    assert decontaminate.find(docs, items.limit(0)).count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(rows)


def test_short_items_are_found_as_words(spark):
    rows = [(1, "banana bread"), (2, "the catalogue"), (3, "Plan A."), (4, "a"), (5, "cat"), (6, "say CAT, please"), (7, "category"), (8, "seven words of item ate"), (9, "sevn words of item ate")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = lambda text: spark.createDataFrame([(1, text)], "item_id long, text string")
    assert bag(decontaminate.find(docs, items("a")), "doc_id") == [(3,), (4,)]
    assert bag(decontaminate.find(docs, items("Cat")), "doc_id") == [(5,), (6,)]
    assert bag(decontaminate.clean(docs, items("seven words of item")), "doc_id") == [(k,) for k in range(1, 8)]
    assert [decontaminate.budget(n) for n in (3, 9, 10, 39, 40, 41)] == [0, 0, 1, 3, 4, 4]


def test_matcher_agrees_with_edit_distance():
    import random

    rng = random.Random(4)

    def least(p, s):
        row = [0] * (len(s) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(s, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    items = [(k, bytes(rng.choice(b"abcde ") for _ in range(rng.randint(5, 110)))) for k in range(5)]
    matcher = decontaminate.Matcher(items)
    for _ in range(200):
        own = bytearray(decontaminate.plain(rng.choice(items)[1]))
        for _ in range(rng.randint(0, 12)):
            j = rng.randrange(len(own)) if own else 0
            own[j : j + 1] = bytes(rng.choice(b"abcde") for _ in range(rng.randint(0, 2)))
        text = decontaminate.plain(bytes(rng.choice(b"abcde ") for _ in range(40)) + bytes(own) + bytes(rng.choice(b"abcde ") for _ in range(40)))
        want = {k: least(p, text) for k, p in matcher.items if least(p, text) <= decontaminate.budget(len(p))}
        got = {}
        for k, distance, _ in matcher.matches(text):
            got[k] = min(distance, got.get(k, 999))
        assert got == want


# --- 10: quality


def test_quality_separates_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality.score(docs.withColumn("score", F.lit("x")), quality.train(docs, labels))
    own = scored.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    right, n = own.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.95
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 4 == 2) for k, h in held.items())


def test_quality_without_labels_and_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, None), (2, 1), (3, 0)], "doc_id long, quality int")
    scored = quality.score(docs, quality.train(docs, labels))
    assert scored.count() == docs.count() and scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.score(docs, quality.train(docs, labels.limit(0))).count() == docs.count()


def test_the_sample_is_bounded_by_rows(spark, monkeypatch):
    """One picked doc_id with many rows doesn't send more than the bounds to the driver."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u, prior: seen.append((len(p), len(u))))
    quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), 5, 7)
    assert seen == [(5, 7)]


def plain_risk(w, p, u, prior):
    """The non-negative risk with logistic loss, term by term."""
    loss = lambda m: np.log1p(np.exp(-m))
    margin = lambda x: x @ w[:-1] + w[-1]
    negative = loss(-margin(u)).mean() - prior * loss(-margin(p)).mean()
    return prior * loss(margin(p)).mean() + max(0.0, negative), negative


def test_fit_minimises_the_risk(monkeypatch):
    """No plain descent from many starts finds a risk well below that of the fit; the scores order the classes."""
    rng = np.random.default_rng(3)
    width = len(quality.NAMES)
    good, bad = rng.normal(0.8, 1, (900, width)), rng.normal(-0.8, 1, (900, width))
    positive, unlabelled, prior = good[:300], np.concatenate([good[300:600], bad[:300]]), 0.5
    model = quality.fit(positive, unlabelled, prior)
    p, u = model.inputs(positive), model.inputs(unlabelled)
    own, _ = plain_risk(model.weights, p, u, prior)
    for seed in range(3):
        w = np.random.default_rng(seed).normal(0, 0.1, len(model.weights))
        for _ in range(3000):
            sp, su = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) for x in (p, u))
            if plain_risk(w, p, u, prior)[1] < 0:
                break
            g = np.append(p.T @ (sp - 1), (sp - 1).sum()) * prior / len(p) + np.append(u.T @ su, su.sum()) / len(u) - prior * np.append(p.T @ sp, sp.sum()) / len(p)
            w = w - 0.1 * g
        assert own <= plain_risk(w, p, u, prior)[0] + 0.02
    assert (model.scores(good[600:]) > 0.5).mean() > 0.95 and (model.scores(bad[300:]) < 0.5).mean() > 0.95


def test_fit_turns_back_where_the_negatives_risk_is_below_zero():
    """With a prior far too high the unbiased risk would fall without end; the fit keeps the negatives' part near zero
    and its weights bounded."""
    rng = np.random.default_rng(5)
    width = len(quality.NAMES)
    positive, unlabelled = rng.normal(2, 1, (200, width)), rng.normal(-2, 1, (400, width))
    model = quality.fit(positive, unlabelled, 0.95)
    _, negative = plain_risk(model.weights, model.inputs(positive), model.inputs(unlabelled), 0.95)
    assert negative > -0.5 and np.abs(model.weights).max() < 20


@pytest.mark.parametrize("share", [0.15, 0.5, 0.85])
def test_class_prior_of_known_mixtures(share):
    """The estimate sees no label of the mixture, and comes near its share of positives."""
    rng = np.random.default_rng(11)
    width = len(quality.NAMES)
    good, bad = (lambda n: rng.normal(0.7, 1, (n, width))), (lambda n: rng.normal(-0.7, 1, (n, width)))
    n = 3000
    mixture = np.concatenate([good(int(n * share)), bad(n - int(n * share))])
    assert abs(quality.class_prior(good(1500), rng.permutation(mixture)) - share) < 0.06
    assert quality.class_prior(good(2), mixture) == quality.class_prior(good(0), mixture) == 0.5


def test_best_bin_equals_counting():
    rng = np.random.default_rng(2)
    p, u = np.round(rng.normal(1, 1, 90), 1), np.round(np.concatenate([rng.normal(1, 1, 80), rng.normal(-2, 1, 120)]), 1)
    spread = sum(math.sqrt(math.log(4 / quality.DOUBT) / (2 * len(x))) for x in (p, u))
    bins = []
    for least in sorted(set(p)):
        own, other = sum(x >= least for x in p) / len(p), sum(x >= least for x in u) / len(u)
        bins.append(((other + spread) / own, other / own))
    near = min(b for b, _ in bins) * (1 + quality.NEAR)
    assert math.isclose(quality.best_bin(p, u), min(next(e for b, e in bins if b <= near), 1.0))


def test_quality_query_equals_scoring_row_by_row(spark):
    """The whole query anew: the sample from all held-in rows, the estimated prior, the fit, and each text's score; and the
    labels of held-out rows and labels other than 1 change nothing."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    values = {r["doc_id"]: quality.features((r["text"] or "").encode()) for r in docs}
    positive = np.array(sorted(values[k] for k in values if not held[k] and labels.get(k) == 1))
    unlabelled = np.array(sorted(values[k] for k in values if not held[k]))
    model = quality.fit(positive, unlabelled, quality.class_prior(positive, unlabelled))
    got = {r["doc_id"]: r for r in quality.op10_quality_classifier(spark, d).collect()}
    assert set(got) == set(values)
    for k, v in values.items():
        score = float(model.scores(np.array([v]))[0])
        assert abs(got[k]["score"] - score) < 1e-8 and got[k]["held_out"] == held[k] and got[k]["predicted"] == int(got[k]["score"] >= 0.7)
    frame = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    other = frame.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1).when(F.col("quality") != 1, None).otherwise(F.col("quality")))
    again = quality.train(spark.read.parquet(f"{d}/documents.parquet"), other)
    assert np.allclose(again.weights, model.weights, rtol=0, atol=1e-9)


# --- what they share


@pytest.mark.parametrize("hot_rows, broadcast", [(1024, 32 << 20), (3, 32 << 20), (3, 0)])
def test_join_by_hot_keys(spark, monkeypatch, hot_rows, broadcast):
    """The join is the plain one whether hot keys are none, broadcast, or dealt to several tasks."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    rows = [(k % 7 if k % 2 else 100, k) for k in range(60)] + [(None, 1), (55, 2)]
    left = spark.createDataFrame(rows, "key long, place long")
    counts = common.scratch(left.filter("key != 55").groupBy("key").agg(F.count("*").alias("n"), F.max("place").alias("most")), "counts")
    got = common.join_hot(left, counts, ["key"], "n", "place")
    want = sorted((k, p, max(q for j, q in rows if j == k)) for k, p in rows if k not in (None, 55))
    assert sorted(map(tuple, got.select("key", "place", "most").collect())) == want


def test_names_that_are_free(spark):
    frame = spark.createDataFrame([(1, 2)], "Copy long, copy_ long")
    assert common.free_name(frame, "copy") == "copy__" and common.free_name(frame, "other") == "other"


# --- all


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "some words of a test item that is long")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert line_dedup.dedup_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert license_scan.scan(empty)[0].count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert near_dup.classes(empty).count() == near_dup.keep_one(empty).count() == 0
    assert decontaminate.find(empty, items).count() == 0
    assert quality.score(empty, quality.train(empty, labels)).count() == 0
    assert token_counts.token_counts(empty).count() == 0
    for write, read in ((token_output.write_store, token_output.read_store), (media.write_media, media.read_media)):
        path = scratch_path(spark, "none")
        write(empty, path)
        assert read(spark, path).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels, items = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    want = quality.score(docs, quality.train(docs, labels)).filter("predicted = 1").select(docs.columns)
    rows = {r["doc_id"]: r for r in want.collect()}
    classes = plain_classes([(k, r["text"]) for k, r in rows.items()])
    heads = {c for _, n, c in classes if n} | {k for k, n, _ in classes if not n}
    matcher = decontaminate.Matcher([(r["item_id"], r["text"].encode()) for r in items.collect()])
    clean = [k for k in sorted(heads) if not matcher.matches((rows[k]["text"] or "").encode())]
    copies = {r["doc_id"]: r["mix"]["copies"] for r in mixing.mix(want.filter(F.col("doc_id").isin(clean))).collect()}
    tokenizer = load(TOKENIZER)
    expected, start = [], 0
    for k in clean:
        ids = [*tokenizer.encode(rows[k]["text"] or "", add_special_tokens=False).ids, 0]
        for _ in range(copies[k]):
            expected.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert len(pipeline.STAGES) == 5 and expected
    assert bag(pipeline.run(spark, d), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    assert json.dumps([n for n, _ in pipeline.STAGES])


def test_pipeline_stages_keep_clashing_columns(spark, docs):
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.001"
    names = ("predicted", "source_size", "target", "Copies", "_copy", "_digest", "_doc_id", "_own_digest", "mix")
    docs = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name
    rows = set(bag(docs, *docs.columns))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    good = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).filter("predicted = 1").count()
    plain = docs.select("doc_id", "text", "source")
    counts = [good, near_dup.keep_one(plain).count(), docs.count(), mixing.mix(plain).agg(F.sum("mix.copies")).first()[0]]
    for (name, stage), want in zip(pipeline.STAGES, counts, strict=False):
        got = stage(spark, docs, d)
        assert got.columns == docs.columns, name
        found = bag(got, *got.columns)
        assert set(found) <= rows and len(found) == want, name


def test_very_long_texts(spark):
    """One text of six megabytes beside short ones: whole results from every operator that cuts its batches."""
    rng = np.random.default_rng(9)
    some = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400)]
    lines = [" ".join(some[i] for i in rng.integers(0, 400, 12)) for _ in range(70_000)]
    item = "a passage of a benchmark item that stands at the very end of it"
    long = "\n".join(lines) + "\nUnder the General Public License\n" + item
    assert len(long) > 5 << 20
    rows = [(1, long), (2, "short"), (3, None), (4, lines[0] + "\n" + lines[0]), (5, lines[0]), (6, lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[1]["n_lines"] == 70_002 and kept[1]["n_dropped"] >= 1 and kept[6]["n_dropped"] == 0
    found = {r["doc_id"]: r for r in license_scan.scan(docs)[0].collect()}
    assert found[1]["n_words"] == len(license_scan._word.findall(long.encode())) and found[1]["base_labels"] == "gpl"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert bag(decontaminate.find(docs, items), "doc_id", "distance") == [(1, 0)]
    model = quality.Model(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)), np.ones(2 * len(quality.NAMES) + 1) / 50)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert scores[1] == pytest.approx(model.scores(np.array([quality.features(long.encode())]))[0], abs=1e-8)
    path = scratch_path(spark, "long")
    media.write_media(docs, path)
    assert {r["doc_id"]: r["payload_sha256"] for r in media.read_media(spark, path).collect()}[1] == hashlib.sha256(media.payload(long.encode())).hexdigest()
    near = {r["doc_id"]: r["n_shingles"] for r in near_dup.classes(docs).collect()}
    words = WORD.findall(long.lower())
    assert near[1] == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()}
    assert counted[1] == len(load(TOKENIZER).encode(long, add_special_tokens=False).ids)
