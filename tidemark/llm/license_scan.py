"""License scans by diagonal voting.

Templates are phrases, openings, paragraphs and whole texts of licences. The rolling word k-gram hashes of every text are
joined by Spark to the positions at which templates hold them; a hit at word p of a text and word t of a template votes
for the diagonal p - t. Votes are summed by diagonal, neighbouring diagonals (words left out or put in) are merged as far
as a tenth of the template's length, and the spans of those with enough votes are verified word by word: what they share
with the template counts against the longer of the two. A text is cut into words once for all its spans. A sieve of the templates' own hashes, a table of fixed size, goes ahead
of the join, so that only k-grams which some template holds are made into rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, joined, mix, scratch, slices, texts, word_hashes, words

#: Phrases that count wherever their words stand consecutively, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Openings, paragraphs and whole texts of public licences, with labels of this method's own.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under the gnu general public license version": "gpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability": "mit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl-notice",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software": "bsl",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely": "zlib",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution": "zlib",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense",
}
K_BASE, K = 2, 3
#: Diagonals of a template as far apart as this share of its words (or BAND) are one; share of a template's k-grams that
#: must vote; least likeness of a span.
WIDTH, BAND, VOTES, LIKE = 0.1, 3, 0.5, 0.85
_word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def rolled(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive values; seeded by k."""
    n = len(values) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    for j in range(k):
        out = mix(out + values[j : j + max(n, 0)]) + np.uint64(j + 1)
    return out


def template_rows(base: dict[str, str], templates: dict[str, str]) -> list[tuple]:
    """(gram, template, label, is_base, at, size): each template's k-gram hashes with their positions. Base phrases
    use k-grams of K_BASE words, other templates of K."""
    rows = []
    for number, (phrase, label, is_base) in enumerate([*((p, x, True) for p, x in base.items()), *((p, x, False) for p, x in templates.items())]):
        own = phrase.encode().translate(_LOWER)
        data, offsets = joined([own])
        starts, ends, _ = words(data, offsets, ALNUM)
        k = K_BASE if is_base else K
        if len(starts) < k:
            raise ValueError(f"a template needs {k} words: {phrase}")
        for at, gram in enumerate(rolled(word_hashes(data, starts, ends), k).view(np.int64).tolist()):
            rows.append((gram, number, label, is_base, at, len(starts) - k + 1))
    return rows


def gram_words(base: dict[str, str], templates: dict[str, str]) -> dict[int, set[tuple[bytes, ...]]]:
    """The words of each template's k-grams, by their hash."""
    found: dict[int, set[tuple[bytes, ...]]] = {}
    phrases = [_word.findall(p.encode().translate(_LOWER)) for p in [*base, *templates]]
    for gram, number, _, is_base, at, _ in template_rows(base, templates):
        found.setdefault(gram, set()).add(tuple(phrases[number][at : at + (K_BASE if is_base else K)]))
    return found


HITS = "row long, doc_id long, n_words long, hits array<struct<gram: long, at: int>>, text string"


def _hit_rows(batches: Iterator[pa.RecordBatch], grams: np.ndarray, own: dict[int, set[tuple[bytes, ...]]]) -> Iterator[pa.RecordBatch]:
    """The places of templates' k-grams: found by hash, then compared word for word."""
    row = TaskContext.get().partitionId() << 40
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32())]))
    for batch in slices(batches, "text"):
        parts = texts(batch)
        data, offsets = joined(parts)
        data = LOWER[data]
        starts, ends, first = words(data, offsets, ALNUM)
        values = word_hashes(data, starts, ends)
        found_at, found = [], []
        doc = np.repeat(np.arange(len(parts)), np.diff(first))
        for k in (K_BASE, K):
            keys = rolled(values, k).view(np.int64)
            near = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
            at = np.flatnonzero(grams[near] == keys) if len(keys) else np.zeros(0, np.int64)
            at = at[doc[at] == doc[at + k - 1]]
            spans = zip(at.tolist(), keys[at].tolist(), strict=True)
            same = [tuple(data[a:b].tobytes() for a, b in zip(starts[p : p + k].tolist(), ends[p : p + k].tolist(), strict=True)) in own[g] for p, g in spans]
            at = at[np.array(same, bool)]
            found_at.append(at)
            found.append(keys[at])
        at, keys = np.concatenate(found_at), np.concatenate(found)
        order = np.argsort(doc[at], kind="stable") if len(at) else at
        at, keys = at[order], keys[order]
        ends_of = np.searchsorted(doc[at], np.arange(len(parts) + 1), "left") if len(at) else np.zeros(len(parts) + 1, np.int64)
        hits = pa.ListArray.from_arrays(pa.array(ends_of, pa.int32()), pa.StructArray.from_arrays([pa.array(keys), pa.array((at - first[:-1][doc[at]]).astype(np.int32))], names=["gram", "at"]))
        kept = [x if b > a else None for x, a, b in zip(parts, ends_of[:-1], ends_of[1:], strict=True)]
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + n)), batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(first)), hits.cast(kind), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["row", "doc_id", "n_words", "hits", "text"],
        )
        row += n


def likeness(phrase: list[bytes], span: list[bytes]) -> float:
    """Words in the same order, against the longer side."""
    if span == phrase:
        return 1.0
    same = sum(b.size for b in SequenceMatcher(None, phrase, span, autojunk=False).get_matching_blocks())
    return same / max(len(phrase), len(span))


def _verified(pdfs: Iterator[pd.DataFrame], phrases: list[list[bytes]]) -> Iterator[pd.DataFrame]:
    """The likeness of each span to its template, by the words themselves; a text's spans come together."""
    for pdf in pdfs:
        out = []
        for row, text, spans in zip(pdf["row"], pdf["text"], pdf["spans"], strict=True):
            own = _word.findall(text.encode().translate(_LOWER))
            out += [(row, s["template"], int(s["start"]), likeness(phrases[s["template"]], own[max(s["start"], 0) : s["stop"]])) for s in spans]
        yield pd.DataFrame(out, columns=["row", "template", "start", "like"])


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """Per row of docs (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), and the verified
    spans (row, doc_id, template, label, start, like).

    Null and empty texts have no words, no labels (empty strings) and score 0; rows that repeat a doc_id are judged
    each by itself. score is the greatest likeness of a span to its template; a base phrase scores 1."""
    spark = docs.sparkSession
    rows = template_rows(base, templates)
    grams = np.unique(np.array([r[0] for r in rows], np.int64))
    table = F.broadcast(spark.createDataFrame(rows, "gram long, template int, label string, is_base boolean, tpos int, size int"))  # a fixed table
    own = gram_words(base, templates)
    hits = scratch(docs.select("doc_id", "text").mapInArrow(lambda it: _hit_rows(it, grams, own), HITS), "license-hits")
    votes = hits.select("row", F.explode("hits").alias("hit")).select("row", "hit.gram", "hit.at").join(table, "gram")
    diagonals = votes.groupBy("row", "template", "label", "is_base", "size", (F.col("at") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"))
    places = diagonals.filter(F.col("is_base") & (F.col("votes") == F.col("size")))
    by_base = places.groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_set")
    )
    # a band starts at each diagonal and holds those within its width; of bands that start within one width the fullest is tried
    along = W.partitionBy("row", "template").orderBy("diagonal")
    free = diagonals.filter(~F.col("is_base")).withColumn("width", F.greatest(F.lit(BAND), F.floor(F.lit(WIDTH) * F.col("size")).cast("int")))
    phrases = [_word.findall(p.encode().translate(_LOWER)) for p in [*base, *templates]]
    widths = sorted({max(BAND, int(WIDTH * (len(p) - K + 1))) for p in phrases[len(base) :]})
    reach = [(w, W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, w)) for w in widths]
    held = F.coalesce(*(F.when(F.col("width") == w, F.sum("votes").over(over)) for w, over in reach))
    last = F.coalesce(*(F.when(F.col("width") == w, F.max("diagonal").over(over)) for w, over in reach))
    bands = free.withColumns({"held": held, "last": last}).filter(F.col("held") >= VOTES * F.col("size"))
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= F.col("width"), 0).otherwise(1)
    chains = bands.withColumn("new", new).withColumn("chain", F.sum("new").over(along)).withColumn("low", F.min("diagonal").over(W.partitionBy("row", "template", "chain")))
    cells = chains.withColumn("cell", F.floor((F.col("diagonal") - F.col("low")) / (F.col("width") + 1)))
    best = F.max_by(F.struct("diagonal", "last"), F.struct("held", -F.col("diagonal")))
    likely = cells.groupBy("row", "template", "size", "chain", "cell").agg(best.alias("best"))
    span = F.struct("template", F.col("best.diagonal").alias("start"), (F.col("best.last") + F.col("size") + K - 1).alias("stop"))
    spans = likely.groupBy("row").agg(F.collect_list(span).alias("spans")).join(hits.select("row", "text"), "row")
    verified = spans.mapInPandas(lambda it: _verified(it, phrases), "row long, template int, start int, like double").filter(F.col("like") >= LIKE)
    names = F.broadcast(spark.createDataFrame([(n, x) for n, x in enumerate([*base.values(), *templates.values()])], "template int, label string"))
    verified = scratch(verified.join(names, "template"), "license-spans")
    by_span = verified.groupBy("row").agg(F.collect_set("label").alias("span_set"), F.max("like").alias("like"))
    none = F.array().cast("array<string>")
    labelled = hits.select("row", "doc_id", "n_words").join(by_base.join(by_span, "row", "full"), "row", "left")
    found = labelled.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(F.coalesce("base_set", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base_set", none), F.coalesce("span_set", none))), ",").alias("labels"),
        F.round(F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("like", F.lit(0.0)), F.lit(1.0))), 6).alias("score"),
    )
    return found, verified.join(hits.select("row", "doc_id"), "row").select("row", "doc_id", "template", "label", "start", "like")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
