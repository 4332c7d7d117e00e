"""Extraction, divergence and ranked search against plain renderings of their contracts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence, html_extract, ranked_search
from tidemark.llm.common import scratch_path

PAGES = "page_id long, url string, html string, host string, text string, wrapper string"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- 11: extraction


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


CASES = [
    ("<nav><ul><li><a href='/a'>A</a></li></ul></nav><article><h1>Head &amp; more</h1><p>One  two\n three</p><p><b>Four<br>five</article><footer>end</footer>", "Head & more\nOne two three\nFour five"),
    ("<header>Site</header><div class='ad'>Buy</div><article><p>Kept</p><aside>Side</aside><div class=\"x notice\">Note</div><form><p>Mail</p></form><section id=comments><p>First!</p></section><p>Last</p></article>", "Kept\nLast"),
    ("<article><p>a &lt;b&gt; &#233;&#x41; &nbsp; c</p><!-- gone --><script>no()</script><ul><li>x<li>y</ul></article>", "a <b> éA c\nx\ny"),
    ("<main><h2>Title</h2><div><p>Text</p></div><div class='related'>Other</div></main><div id='sidebar'>S</div>", "Title\nText"),
    ("<div class='menu'><a href='/'>m</a></div><div class='post-content with-sidebar'><p>Body text</p></div>", "Body text"),
    ("<article><header><h1>Own head</h1><p>by someone</p></header><p>a<span>b</span> c</p><table><tr><td>1<td>2<tr><td>3</table></article>", "Own head\nab c\n1\n2\n3"),
    ("<article><p>open <a href='x>y'>link</a> and 1 < 2 <b>bold", "open link and 1 < 2 bold"),
    ("<article class='post has-comments'><p>x</p><article class=comment><p>reply</p></article></article>", "x"),
    ("<nav>only</nav>", ""),
    ("", ""),
]


@pytest.mark.parametrize(("body", "want"), CASES)
def test_one_page(body, want):
    node = html_extract.pattern(page(body))
    assert html_extract.matched(page(body), html_extract.slots(node, 1)) == want


def test_extraction_of_mixed_hosts(spark):
    rows = [(k, f"https://u@{'WWW' if k % 2 else 'www'}.h{k % 3}.org:80/p/{k}", page(body), "x", "y", "z") for k, (body, _) in enumerate(CASES * 3)]
    want = [(k, f"https://u@{'WWW' if k % 2 else 'www'}.h{k % 3}.org:80/p/{k}", text, len(text)) for k, (_, text) in enumerate(CASES * 3)]
    rows += [(None, None, None, None, None, None), (3, None, "plain &amp; simple", None, None, None), rows[1]]
    want += [(None, None, "", 0), (3, None, "plain & simple", 14), want[1]]
    got = [tuple(r) for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    found = html_extract.wrappers(spark.createDataFrame(rows, PAGES)).collect()
    assert {r["host"]: r["pages"] for r in found}["www.h0.org"] == 10 and len(found) == 4


def test_template_texts_of_hosts_without_an_article():
    rng = random.Random(2)
    pages = [page(f"<div class=a><p>Welcome to the site</p><div class=b><p>{' '.join(rng.choices('uvwxyz', k=30))}</p><p>{k} tail</p></div></div><div class=c><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div>") for k in range(6)]
    node = html_extract.pattern(pages[0])
    for text in pages[1:]:
        node = html_extract.align(node, html_extract.pattern(text))
    out = [html_extract.matched(text, html_extract.slots(node, len(pages))) for text in pages]
    assert all(len(x.split("\n")) == 2 and x.endswith(f"{k} tail") and "Welcome" not in x and "three" not in x for k, x in enumerate(out))


def stream(text):
    out = ""
    for kind, own in html_extract.tokens(text):
        if kind == "#":
            out += "#" if own.strip() and not out.endswith("#") else ""
        else:
            out += f"<{own}>" if kind == "<" else f"</{own}>"
    return out


def test_wrappers_take_all_pages_they_were_made_from():
    rng = random.Random(7)

    def tree(depth):
        parts = []
        for _ in range(rng.randint(0, 5)):
            name = rng.choice(["div", "p", "ul", "b", "section", "span"])
            parts.append(rng.choice(["text", f"<{name}{rng.choice(['', ' class=k', ' class=m'])}>{tree(depth - 1) if depth else 'leaf'}</{name}>"]))
        return "".join(parts)

    for _ in range(40):
        pages = [page(tree(3)) for _ in range(rng.randint(2, 7))]
        nodes = [html_extract.pattern(x) for x in pages]
        left = nodes[0]
        for node in nodes[1:]:
            left = html_extract.align(left, html_extract.Node.load(node.dump()))
        own = re.compile(html_extract.regex(left))
        assert all(own.fullmatch(stream(x)) for x in pages)
        assert "|" not in html_extract.regex(left).replace("\\|", "")


def test_groups_and_slots():
    own = lambda *bodies: html_extract.regex(_aligned([f"<div>{b}</div>" for b in bodies]))
    unescape = lambda x: x.replace("\\", "").replace("(?:", "(")
    assert unescape(own("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>")) == "(<div>(<dl>(<dt>(#)</dt><dd>(#)</dd>)+</dl>)</div>)"
    assert unescape(own("<h2>a</h2><p>b</p>", "<p>b</p>")) == "(<div>(<h2>(#)</h2>)?(<p>(#)</p>)</div>)"
    assert unescape(own("<i>a</i><b>b</b>", "<b>b</b><i>a</i>")) == "(<div>((<i>(#)</i>)?(<b>(#)</b>)?)+</div>)"


def _aligned(pages):
    node = html_extract.pattern(pages[0])
    for x in pages[1:]:
        node = html_extract.align(node, html_extract.pattern(x))
    return node


def test_long_and_deep_pages(spark):
    deep = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p></article>"
    long = "<article>" + "".join(f"<p class=c{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}>w{k}</p><h2>h</h2>" for k in range(20000)) + "</article>"
    rows = [(1, "http://a/", deep, None, None, None), (2, "http://a/", long, None, None, None), (3, "http://a/", "<" * 5000 + "x", None, None, None)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == "deep\nafter" and got[2].count("\n") == 39999 and got[3] == "<" * 5000 + "x"
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


# --- 12: divergence


def divergences(rows, least=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(text or ""))) for lang, source, text in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        df[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, source in count:
        kept = [t for t, n in df[lang].items() if n >= least]
        of = lambda counts, kept=kept: {t: 1 + 10**9 * (counts[t] + 2) // (sum(counts[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        own, whole = of(count[lang, source]), of(sum((c for (x, _), c in count.items() if x == lang), Counter()))
        pairs = []
        for x, other in count:
            if x == lang and other != source:
                theirs = of(count[x, other])
                pairs.append((other, sum(f(own[t], theirs[t]) for t in kept)))
        terms = [(t, f(own[t], whole[t])) for t in kept if count[lang, source][t] and own[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
            order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(order)]
    return sorted(out)


def test_divergence(spark, docs, empty):
    rng = random.Random(3)
    names = [f"s{k}" for k in range(70)] + ["", "é", None]
    rows = [(k, " ".join(rng.choices(["Alpha", "beta7gamma", "délta", "of-the", "x", "rare%d" % (k % 40)], k=rng.randint(0, 30))) if k % 50 else None, rng.choice(["en", "en", "fr", None]), rng.choice(names), k, 0.5, "d") for k in range(900)]
    rows += [(1, "word", "xx", "only", 1, 0.5, "d"), (2, None, "xx", "two", 1, 0.5, "d")]
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, docs.schema)).collect())
    assert got == divergences([(r[2], r[3], r[1]) for r in rows])
    assert divergence.audit(empty).count() == 0
    got = sorted(tuple(r) for r in divergence.audit(docs).collect())
    assert got == divergences([(r["lang"], r["source"], r["text"]) for r in docs.collect()])


def test_shares_of_great_counts():
    count, n, v = np.array([0, 5, 7 * 10**12, 10**14], np.int64), 5 * 10**14, 10**6
    assert divergence.shares(count, n, v).tolist() == [1 + 10**9 * (int(c) + 2) // (n + 2 * v) for c in count]


# --- 13: ranked search


def ranked(rows, items, k=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(d, Counter(term.findall(ascii_lower(t or "")))) for d, t in rows]
    docs = [(d, c) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        own = Counter(term.findall(ascii_lower(text or "")))
        scored = []
        for d, c in docs:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in own.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_search(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    items = [(k, rows[k][1]) for k in range(0, 40, 3)] + [(100, None), (101, ""), (102, "nowhere"), (None, "alpha1 ALPHA1 beta2"), (103, "all rights reserved é")]
    held = spark.createDataFrame(items, "item_id long, text string")
    index = ranked_search.build(docs, scratch_path(spark, "index"))
    assert sorted((tuple(r) for r in ranked_search.search(index, held).collect()), key=repr) == ranked(rows, items)
    assert ranked_search.search(index, held.limit(0)).count() == 0
    assert ranked_search.search(ranked_search.build(empty, scratch_path(spark, "index")), held).count() == 0


def shards_of(rows, cut):
    n_docs = sum(bool(t.split()) for _, t in rows)
    n_terms = sum(len(t.split()) for _, t in rows)
    batches = [b for k in range(0, len(rows), cut) for b in ranked_search._shard([(d, t.encode()) for d, t in rows[k : k + cut]], k, n_docs, n_terms)]
    return batches, n_docs


@pytest.mark.parametrize("cut", [7, 60, 1000])
def test_search_over_shards_with_ties(cut):
    rng = random.Random(cut)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(d, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60])))) for d in rng.sample(range(5000), 400)]
    rows += [(d, rows[0][1] or "w1 w2") for d in range(6000, 6060)]
    rng.shuffle(rows)
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 50])))) for k in range(25)] + [(99, rows[0][1])]
    batches, n_docs = shards_of(rows, cut)
    df = Counter(t for _, text in rows for t in set(text.split()))
    queries = [(k, item, {t: q * w for t, q in Counter(text.split()).items() if (w := ranked_search.weight(n_docs, df[t])) > 0}) for k, (item, text) in enumerate(items)]
    out = pa.Table.from_batches(list(ranked_search._searched(iter(batches), queries, 10))).to_pylist()
    want = [(item, d, s) for item, _, d, s in ranked(rows, items)]
    assert sorted((r["item_id"], r["doc_id"], r["score"]) for r in out) == sorted(want)


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(4)
    sizes = np.array([1, 2, 500, 3, 1, 64])
    ends = np.cumsum(sizes)
    docs = np.concatenate([np.sort(rng.choice(2000, n, replace=False)) for n in sizes])
    impact = rng.integers(1, 5, len(docs))
    order, left = ranked_search.treaps(ends - sizes, ends, docs, impact)
    depths = []

    def check(at, end, depth):
        if at == end:
            return []
        depths.append(depth)
        middle = at + 1 + left[at]
        below = [*check(at + 1, middle, depth + 1), order[at], *check(middle, end, depth + 1)]
        assert impact[order[at]] == impact[below].max()
        return below

    for size, end in zip(sizes, ends, strict=True):
        assert check(end - size, end, 0) == list(range(end - size, end))
    assert max(depths) < 60


def test_search_of_a_very_long_text(spark):
    text = "needle " + "hay " * 1_500_000
    rows = [(1, text), (2, "needle"), (3, None)]
    index = ranked_search.build(spark.createDataFrame(rows, "doc_id long, text string"), scratch_path(spark, "index"))
    got = [tuple(r) for r in ranked_search.search(index, spark.createDataFrame([(5, "needle hay")], "item_id long, text string")).collect()]
    assert sorted(got, key=repr) == ranked(rows, [(5, "needle hay")])
