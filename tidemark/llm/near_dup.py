"""N-gram Jaccard join with a token-group matrix.

A document's tokens are the 64-bit hashes of its distinct word shingles. Two documents link when their Jaccard
similarity reaches a percentage. Equal sets are one set from the start. Then:

1. Sieve. A set that has a partner shares with it the first tokens of their intersection, in hash order, and these lie
   in a prefix of both. Spark counts prefix tokens; sets with too few shared ones go. Over the full sets of those left,
   the share of tokens held by any other set must itself reach the percentage.
2. Groups. Sets with the same least shared token, in any of KEYS orders, form a group, dealt into parts of bounded
   sets and tokens. A set's own group always qualifies, so it is opened at once: the members are compared from the most
   popular one on, whose tokens most other sets hold and to which most near copies link. One root of each part's
   components goes to the next round while that pays.
3. Matrix. The parts of the first order are the groups: similar sets stand together, linked or not. The union of each
   group's tokens is a table of (group, token), with the components that hold the token there; tokens of one component
   alone can't make a link and are left out. Sets have been compared within their own group; each queries the groups
   after it with its rarest tokens, more of them than may be missing from a partner. Groups meet as groups: what all
   sets of one ask for is one row a token, and which of its sets find enough in another is counted in a task that holds
   the one group's sets and what they share with a bounded lot of others. For the groups met, a set's overlap with the
   stored union is counted, and only where that reaches the percentage is the group opened: its members are fetched and
   compared.
4. Links between components are joined by pointer jumping over Spark tables.

No step makes the pairs within a group as rows, or a row for each set, group and token, and no part or group that one
task holds grows with the input. A token that many groups hold is dealt by group to as many tasks as it needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_ROWS, join_hot, release, scratch, shingle_sets, slices, small, texts

#: Sets, and about how many tokens, that one task compares with each other; the extra prefixes of the sieve and of the
#: matrix's queries, as divisors of a set's size; orders of grouping.
PART, PART_TOKENS, EXTRA, MORE, KEYS = 256, 1 << 18, 20, 5, 3


def least(n, percent: int):
    """The fewest tokens that a set of n (a number or a column) shares with any partner."""
    if isinstance(n, Column):
        return F.ceil(n * percent / 100).cast("long")
    return (n * percent + 99) // 100


def prefix_size(n: int, percent: int) -> int:
    return min(n, n - least(n, percent) + 1 + n // EXTRA)


def links(a: int, b: int, common, percent: int):
    """Whether sets of a and b tokens with so many in common link: 100 * common >= percent * union."""
    return (100 + percent) * common >= percent * (a + b)


DIGESTS = "doc_id long, digest long, n long, set long, prefix array<long>"
SETS = "set long, n long, tokens array<long>"


def _list(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def _name(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _digests(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, offsets = shingle_sets(texts(batch), words)
        own = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        prefixes = [x[: prefix_size(len(x), percent)] for x in own]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("digest"),
                pa.array(np.diff(offsets)),
                pa.array([_name(x) if len(x) else None for x in own], pa.int64()),
                _list(np.concatenate([values[:0], *prefixes]), list(map(len, prefixes))),
            ],
            names=["doc_id", "digest", "n", "set", "prefix"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        values, offsets = shingle_sets(texts(batch), words)
        own = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("set"), pa.array(np.diff(offsets)), _list(values, list(map(len, own))), pa.array([_name(x) if len(x) else None for x in own], pa.int64())],
            names=["wanted", "n", "tokens", "set"],
        )


def _parts_of(count: Column, tokens: Column) -> Column:
    """Into how many parts so many sets with so many tokens are dealt."""
    return F.ceil(F.greatest(count / PART, tokens / PART_TOKENS)).cast("long")


def _part(key: Column, parts: Column, deal: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(deal)), parts)


def _sieve(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """set, n and shared (tokens that another set holds too, with how many hold it) of sets that may have a partner."""
    owned = rows.filter("set IS NOT NULL")
    tokens = owned.select("set", F.explode("prefix").alias("token"))
    held = tokens.groupBy("token").agg(F.min("set").alias("low"), F.max("set").alias("high"))
    shared = scratch(held.filter("low != high").select("token"), "shared-prefix")
    hits = tokens.join(shared.hint("shuffle_hash"), "token").groupBy("set").agg(F.count("*").alias("hits"))
    # rows of one text count its hits again and again
    sets = owned.groupBy("set").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.min("doc_id").alias("own_id"), F.coalesce(F.min_by("digest", "doc_id"), F.min("digest")).alias("own_digest"))
    few = F.floor(least(F.col("n"), percent) / EXTRA) + 1
    likely = scratch(hits.join(sets, "set").filter(F.col("hits") >= few * F.col("copies")).select("set", "own_id", "own_digest"), "likely-sets")
    # one row's text stands for a set; its doc_id may be null
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    picked = docs.join(small(likely, 32), same).select("set", "text")
    full = picked.mapInArrow(lambda it: _full_sets(it, words), f"wanted long, {SETS.replace('set long, ', '')}, set long")
    full = scratch(full.filter("wanted = set").select("set", "n", "tokens").dropDuplicates(["set"]), "likely-tokens")
    each = full.select("set", F.explode("tokens").alias("token"))
    holders = each.groupBy("token").agg(F.count("*").cast("int").alias("holders")).filter("holders > 1")
    holders = scratch(holders, "shared-tokens")
    # two lists of one group are in one order
    lists = each.join(holders.hint("shuffle_hash"), "token").groupBy("set").agg(F.collect_list("holders").alias("h"), F.collect_list("token").alias("t"))
    shared_of = lists.join(full.select("set", "n"), "set").select("set", "n", F.array_sort(F.arrays_zip(F.col("h").alias("holders"), F.col("t").alias("token"))).alias("shared"))
    return scratch(shared_of.filter(F.size("shared") >= least(F.col("n"), percent)), "candidate-sets")


class _Sets:
    """Some sets, with overlaps by table look-up."""

    def __init__(self, tokens: pa.ChunkedArray, sizes: pa.ChunkedArray):
        whole = tokens.combine_chunks()
        self.starts = whole.offsets.to_numpy().astype(np.int64) - whole.offsets[0].as_py()
        flat = whole.flatten().to_numpy()
        self.kinds, self.ids = np.unique(flat, return_inverse=True)
        self.sizes = sizes.to_numpy().astype(np.int64)

    def common(self, k: int) -> np.ndarray:
        """How many tokens each set shares with set k."""
        held = np.zeros(len(self.kinds), np.int64)
        held[self.ids[self.starts[k] : self.starts[k + 1]]] = 1
        sums = np.concatenate([[0], np.cumsum(held[self.ids])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


def _link_part(table: pa.Table, percent: int) -> pa.Table:
    """The component of each set within a part; its root is the member that was compared with the others first."""
    sets = _Sets(table.column("tokens"), table.column("n"))
    n = len(sets.sizes)
    root = np.arange(n)
    for k in np.lexsort((table.column("set").to_numpy(), -table.column("popular").to_numpy())):
        if (root == root[0]).all():
            break
        near = links(sets.sizes[k], sets.sizes, sets.common(k), percent)
        joined = np.unique(root[near | (np.arange(n) == k)])
        root[np.isin(root, joined)] = root[k]
    names = table.column("set").to_numpy()
    return pa.table({"set": names, "root": names[root], "n": table.column("n"), "group": table.column("group"), "parts": table.column("parts")})


def _least_by(tokens: str, order: int) -> Column:
    """The least of some tokens in one of several orders; equal sets of tokens have equal ones."""
    return F.array_min(F.transform(tokens, lambda t: F.xxhash64(t, F.lit(order))))


def _dealt(grouped: DataFrame, deal: int, least_members: int = 1) -> DataFrame:
    """grouped (set, n, group) with parts and part, groups of fewer members left out."""
    counts = grouped.groupBy("group").agg(F.count("*").alias("members"), F.sum("n").alias("all_tokens")).filter(F.col("members") >= least_members)
    counts = scratch(counts.select("group", "members", _parts_of(F.col("members"), F.col("all_tokens")).alias("parts")), "groups")
    return join_hot(grouped, counts, ["group"], "members", "set").withColumn("part", _part(F.col("set"), F.col("parts"), deal))


def _parts(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links found by rounds of bounded parts.

    A round's roots in groups of several parts are dealt anew, while that halves them; what is left to link is the
    matrix's."""
    popular = F.aggregate("shared.holders", F.lit(0).cast("long"), lambda a, x: a + x) / F.col("n")
    tokens = sets.select("set", popular.alias("popular"), F.col("shared.token").alias("tokens"))
    keys = [_least_by("shared.token", k) for k in range(KEYS)]
    current = sets.select("set", "n", F.explode(F.array(*keys)).alias("group"))
    rounds: list[DataFrame] = []
    before = after = None
    while not rounds or 0 < after <= before / 2:
        dealt = _dealt(current, len(rounds), 2).join(tokens, "set")
        linked = dealt.groupBy("group", "part").applyInArrow(lambda t: _link_part(t, percent), "set long, root long, n long, group long, parts long")
        linked = scratch(linked, "linked-parts")
        rounds.append(linked)
        current = linked.filter("set = root AND parts > 1").select("set", "n", "group")
        before, after = linked.filter("parts > 1").count(), current.count()
    found = rounds[0]
    for later in rounds[1:]:
        found = found.unionByName(later)
    return found.filter("set != root").select(F.col("set").alias("a"), F.col("root").alias("b"))


def _hits(queries: pa.Table, union: pa.Table) -> np.ndarray:
    """How many tokens of each query are in a union, as far as other components hold them there."""
    if not len(queries) or not len(union):
        return np.zeros(len(queries), np.int64)
    order = np.argsort(union.column("token").to_numpy())
    token, low, high = (union.column(c).to_numpy()[order] for c in ("token", "low", "high"))
    tokens = queries.column("tokens").combine_chunks()
    ends = tokens.offsets.to_numpy().astype(np.int64) - tokens.offsets[0].as_py()
    flat, comp = tokens.flatten().to_numpy(), queries.column("comp").to_numpy()
    at = np.minimum(np.searchsorted(token, flat), len(token) - 1)
    of = np.repeat(comp, np.diff(ends))
    hit = (token[at] == flat) & ~((low[at] == of) & (high[at] == of))
    sums = np.concatenate([[0], np.cumsum(hit)])
    return sums[ends[1:]] - sums[ends[:-1]]


MET = "set long, n long, other long, other_part long"


def _met(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """For each other group that a group's sets meet, those of them that find enough there."""
    names, n, need = (sets.column(c).to_numpy() for c in ("set", "n", "need"))
    met = [_hits(sets, pa.Table.from_struct_array(seen.values)) >= need for seen in pairs.column("seen")]
    which = [np.flatnonzero(x) for x in met]
    of, own = np.repeat(np.arange(len(which)), list(map(len, which))), np.concatenate([np.zeros(0, np.int64), *which])
    other, other_part = (pairs.column(c).to_numpy()[of] for c in ("other", "other_part"))
    return pa.table({"set": names[own], "n": n[own], "other": other, "other_part": other_part})


def _bounded(queries: pa.Table, union: pa.Table, percent: int) -> pa.Table:
    """The queries whose overlap with a group's stored union, as far as other components hold it, may make a link."""
    return queries.filter(pa.array(_hits(queries, union) >= least(queries.column("n").to_numpy(), percent)))


def _open(queries: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """Links between the components of some queries and those of a group's members."""
    linked: set[tuple[int, int]] = set()
    if len(queries) and len(members):
        both = pa.concat_tables([x.select(["tokens", "n"]) for x in (queries, members)])
        sets, q = _Sets(both.column("tokens"), both.column("n")), len(queries)
        others = members.column("comp").to_numpy()
        for k, comp in enumerate(queries.column("comp").to_pylist()):
            near = links(sets.sizes[k], sets.sizes[q:], sets.common(k)[q:], percent) & (others != comp)
            linked |= {(comp, other) for other in np.unique(others[near]).tolist()}
    return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})


ASKED = "other long, other_part long, lot long, set long, comp long, n long, tokens array<long>"


def _matrix_links(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """a, b: components that are linked by some pair of their sets, found through the token-group matrix."""
    known = sets.join(comp, "set", "left").withColumn("comp", F.coalesce("comp", "set")).withColumn("group", _least_by("shared.token", 0))
    known = scratch(known, "labelled-sets")
    dealt = _dealt(known.select("set", "n", "group"), 0).select("set", "group", "part")
    dealt = scratch(known.drop("group").join(dealt, "set"), "grouped-sets")
    tokens = dealt.select("set", "comp", "group", "part", "n", F.explode("shared.token").alias("token"))
    # the matrix: each group's union, without tokens that one component alone holds
    union = scratch(tokens.groupBy("group", "part", "token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("holders")), "unions")
    spread = union.groupBy("token").agg(F.count("*").alias("spread"), F.min("low").alias("low"), F.max("high").alias("high")).filter("low != high")
    spread = scratch(spread.select("token", "spread"), "contested")
    renamed = [F.col("group").alias("other"), F.col("part").alias("other_part"), "low", "high"]
    matrix = scratch(union.join(spread, "token").select("token", *renamed, "spread"), "matrix")
    # queries: of a set's contested tokens the rarest, so many that a partner must hold 1 + extra of them
    own = F.sort_array(F.collect_list(F.struct("spread", "token"))).alias("own")
    asks = scratch(tokens.join(spread, "token").groupBy("set", "comp", "group", "part", "n").agg(own), "contested-sets")
    may = asks.filter(F.size("own") >= least(F.col("n"), percent))
    extra = F.floor(F.col("n") / MORE).cast("int")
    first = F.slice("own", F.lit(1), F.least(F.size("own"), (F.size("own") - least(F.col("n"), percent) + 1 + extra).cast("int")))
    # a prefix of all tokens has fewer to find than 1 + extra
    need = F.least(F.lit(1) + extra, least(F.col("n"), percent)).alias("need")
    may = may.select("set", "comp", "group", "part", "n", need, first.alias("first"))
    # groups meet by the tokens that any of their sets asks for
    one, group = ["group", "part"], ["other", "other_part"]
    probes = may.select("comp", *one, "need", F.explode("first").alias("s")).groupBy(*one, "s.token", "s.spread")
    probes = probes.agg(F.min("comp").alias("own_low"), F.max("comp").alias("own_high"), F.min("need").alias("need"))
    salts = F.ceil(F.col("spread") / HOT_ROWS).cast("int")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64(*one), salts).cast("int")).drop("spread")
    salted = matrix.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("spread")
    alone = (F.col("low") == F.col("high")) & (F.col("own_low") == F.col("own_high")) & (F.col("low") == F.col("own_low"))
    after = (F.struct(*one) < F.struct(*group)) & ~alone
    seen = F.collect_list(F.struct("token", "low", "high")).alias("seen")
    pairs = probes.join(salted, ["token", "salt"]).filter(after).groupBy(*one, *group).agg(seen, F.min("need").alias("need"))
    pairs = scratch(pairs.filter(F.size("seen") >= F.col("need")).drop("need"), "group-pairs")

    def each_lot(lots: DataFrame, left: DataFrame, right: DataFrame, run, schema: str) -> DataFrame:
        """run on each lot of left and, beside every lot of its group, the rows of right."""
        key = lots.columns
        right = lots.join(right, key[:-1])
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)

    def lots_of(sums: DataFrame, by: list[str]) -> DataFrame:
        return sums.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot"))

    # a group that meets many others meets a bounded lot of them at a time
    meeting = scratch(pairs.groupBy(*one).agg(_parts_of(F.count("*"), F.sum(F.size("seen"))).alias("lots"), F.count("*").alias("rows")), "meeting")
    dealt_pairs = join_hot(pairs, meeting, one, "rows", "other").withColumn("lot", _part(F.xxhash64(*group), F.col("lots"))).drop("lots")
    own_sets = may.select(*one, "set", "comp", "n", "need", F.col("first.token").alias("tokens"))
    met = scratch(each_lot(lots_of(meeting, one), dealt_pairs, own_sets, _met, MET), "met")
    # a group that many sets query meets a bounded lot of them at a time
    asking = scratch(met.groupBy(*group).agg(_parts_of(F.count("*"), F.sum("n")).alias("lots"), F.count("*").alias("rows")), "asking")
    plain = asks.select("set", "comp", "n", F.sort_array("own.token").alias("tokens"))
    asked = join_hot(met.drop("n"), asking, group, "rows", "set").withColumn("lot", _part(F.col("set"), F.col("lots"))).join(plain, "set")
    lots = lots_of(asking, group)
    # the bound, on the stored unions; only groups that some query reaches are opened, for those queries alone
    columns = [x.split()[0] for x in ASKED.split(", ")]
    qualifying = scratch(each_lot(lots, asked.select(*columns), matrix.drop("spread"), lambda a, b: _bounded(a, b, percent), ASKED), "qualifying")
    members = dealt.select(F.col("group").alias("other"), F.col("part").alias("other_part"), "set").join(plain, "set").drop("set")
    members = qualifying.select(*group).distinct().join(members, group)
    found = scratch(each_lot(lots, qualifying, members, lambda a, b: _open(a, b, percent), "a long, b long").distinct(), "component-links")
    for done in (known, dealt, union, spread, matrix, asks, pairs, meeting, met, asking, qualifying):
        release(done)
    return found


def connected(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of edges (a, b), by taking the least label among
    neighbours and then the label's own label, until nothing changes."""
    both = scratch(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = scratch(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        after = stepped.join(jump, "low", "left").select("node", F.col("label").alias("was"), F.least("low", F.coalesce("jump", "low")).alias("label"))
        after = scratch(after, "labels")
        labels = after.select("node", "label")
        if after.filter("was != label").isEmpty():
            return labels


def classes(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id and class for each row of docs.

    Sets are taken after A-Z are lower-cased; a text of fewer words than words has its whole sequence as one shingle;
    null, empty and blank texts have no shingles and are classes of their own. Rows that repeat a doc_id or a text
    each get a row. A class whose doc_ids are all null has a null component_id, and a repeated doc_id can be the least
    of several classes: class (the name of one of its sets; null without shingles) tells those apart."""
    docs = docs.select("doc_id", "text")
    hashed = docs.withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = scratch(hashed.mapInArrow(lambda it: _digests(it, words, percent), DIGESTS), "set-digests")
    sets = _sieve(hashed, rows, words, percent)
    comp = connected(_parts(sets, percent)).select(F.col("node").alias("set"), F.col("label").alias("comp"))
    labels = connected(_matrix_links(sets, comp, percent))
    final = sets.select("set").join(comp, "set", "left").withColumn("comp", F.coalesce("comp", "set"))
    final = final.join(labels.withColumnRenamed("node", "comp"), "comp", "left").select("set", F.coalesce("label", "comp").alias("class"))
    owned = scratch(rows.drop("prefix").join(final, "set", "left").withColumn("class", F.coalesce("class", "set")), "classed")
    heads = scratch(owned.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "class-heads")
    alone = owned.filter("class IS NULL").withColumn("component_id", F.col("doc_id"))
    out = ["doc_id", "digest", F.col("n").alias("n_shingles"), "component_id", "class"]
    return join_hot(owned.filter("class IS NOT NULL"), heads, ["class"], "rows", "digest").select(*out).unionByName(alone.select(*out))


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One row of docs, all columns as they are, for each class: the least doc_id (of equal ones, the least digest).
    Texts without words are classes of their own; rows alike in doc_id and text are one row."""
    found = classes(docs, percent, words)
    single = found.filter("n_shingles = 0").select("doc_id", "digest")
    heads = found.filter("n_shingles > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("head"))
    kept = scratch(heads.select("head.doc_id", "head.digest").unionByName(single).distinct(), "kept-rows")
    names = [f"c{k}" for k in range(len(docs.columns))]
    ident, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    hashed = docs.toDF(*names).withColumn("own", F.xxhash64(F.coalesce(text, F.lit(""))))
    same = F.col(ident).eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest"))
    return hashed.join(kept, same, "left_semi").dropDuplicates([ident, "own"]).drop("own").toDF(*docs.columns)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest", "class")
