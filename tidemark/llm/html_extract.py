"""HTML extraction by union-free wrappers of hosts.

Each page is read as a balanced stream of tokens (elements with HTML's implied ends, and texts). Aligning streams of one
host, element by element, gives a wrapper: a regular expression without alternatives. What only some pages have becomes
an optional group, what repeats or comes in another order a repeated group, texts that differ a slot. Wrappers are first
aligned within tasks, then by host and salt, then by host, so a host of any size is a few rows when it is shuffled, and
no task holds more than a wrapper of bounded width and depth for each of a bounded number of hosts.

A wrapper says which slots hold the article: those inside article elements if the host has them, else inside main, else
inside elements named like content, else in the region of most text, where texts that are the same on all pages and lists
of links are template. Menus, headers, footers, sidebars, notices, adverts, forms and comments are told by their element,
role, class or id. A page is then matched with its host's wrapper, and the texts of the article's slots are its text."""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, join_hot, scratch, slices

#: Elements without content; whose content isn't markup; that end an open paragraph; that bound a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math object".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
BLOCK = ENDS_P | frozenset("body html head li dt dd tr td th caption thead tbody tfoot option legend".split())
#: What an opening element ends, and the elements past which it doesn't look.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("ul ol menu dl table select body html article section aside nav main footer header form".split())
#: Elements, roles and words of class or id that aren't the article's.
OUTSIDE = frozenset("head nav footer aside form menu dialog button select datalist search".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog status".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets"
    " notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond disqus replies form search pager pagination toolbar skip disclaimer".split()
)
CONTENT_WORDS = frozenset("article content post entry story articlebody maincontent main".split())
#: Class names of an article element that isn't one, and words that say what a page has, not what an element is.
NOT_ARTICLES = frozenset("comment comments ad sponsored promo related".split())
SAYS_HAS = frozenset("has with no not without".split())
#: Elements below this depth are read as part of the one at it; labels an element's pattern may have before names of
#: classes are left out; wrappers that a task holds before it hands them on.
DEPTH, WIDTH, HOSTS = 120, 48, 2_000
#: Pages from which a text alike on all of them is template; share of linked text, and links a page, of a list of links.
TEMPLATE_PAGES, LINKED, LINKS = 3, 0.8, 3
TEXT = "#"

_TOKEN = re.compile(r"<!--.*?-->|<!--.*|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@lru_cache(1 << 14)
def label(name: str, attributes: str) -> str:
    """An element's name, then ! if it is outside of the article, ~ for a header, * for content, and its class words."""
    words: set[str] = set()
    names: set[str] = set()
    roles: set[str] = set()
    hidden = body = False
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            for part in value.split():
                names.add(part.lower())
                found = _WORD.findall(_CAMEL.sub("-", part).lower())
                if found and found[0] not in SAYS_HAS:
                    words |= {*found, "".join(found)}
        elif key == "role":
            roles = set(value.lower().split())
        elif key == "itemprop":
            body = body or value.lower() == "articlebody"
        else:
            hidden = hidden or key == "hidden" or value.lower() == "true"
    mark = ""
    if name in ("article", "main", "body", "html") and not hidden and not (name == "article" and names & NOT_ARTICLES):
        mark = "*" if name in ("article", "main") else ""
    elif hidden or name in OUTSIDE or roles & (OUTSIDE_ROLES - {"banner"}) or words & (OUTSIDE_WORDS - {"header", "banner"}):
        mark = "!"
    elif name == "header" or "banner" in roles or "header" in words:
        mark = "~"
    elif "banner" in words:
        mark = "!"
    elif body or "main" in roles or words & CONTENT_WORDS:
        mark = "*"
    return f"{name}{mark}" + "".join(f".{w}" for w in sorted(w for w in words if len(w) < 24)[:6])


@lru_cache(1 << 14)
def bare(name: str) -> str:
    """A label without its class words."""
    return name.split(".", 1)[0]


@lru_cache(1 << 14)
def element(name: str) -> str:
    return bare(name).rstrip("!~*")


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """The balanced stream of a page: ("<", label), ("#", raw text), (">", label)."""
    stack: list[str] = []

    def shut(depth: int) -> Iterator[tuple[str, str]]:
        while len(stack) > depth:
            yield ">", stack.pop()

    at, size = 0, len(text)
    while at < size:
        found = _TOKEN.search(text, at)
        start = found.start() if found else size
        if start > at:
            yield TEXT, text[at:start]
        if not found:
            break
        at = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if (own := element(stack[k])) == name:
                    yield from shut(k)
                    break
                if own in BLOCK and name not in BLOCK:  # an inline end doesn't end the block around it
                    break
            continue
        if name in RAW:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(text, at)
                at = end.end() if end else size
            continue
        if name in ENDS_P or name in SIBLINGS:
            ends = SIBLINGS.get(name, {"p"}) | {"p"}
            for k in range(len(stack) - 1, -1, -1):
                own = element(stack[k])
                if own in ends:
                    lowest = k
                    while lowest and element(stack[lowest - 1]) in ends:
                        lowest -= 1
                    yield from shut(lowest)
                    break
                if own in SCOPES or (own in BLOCK and name in ENDS_P):
                    break
        own = label(name, found[3])
        yield "<", own
        if name in VOID:
            yield ">", own
        else:
            stack.append(own)
    yield from shut(0)


class Node:
    """An element's pattern: items in order, each [repeated, optional, members], a member [label, optional, Node or a
    text's digest (None for a slot)]; and the characters of text right inside, of which some are linked."""

    __slots__ = ("chars", "items", "linked", "links")

    def __init__(self) -> None:
        self.items: list[list] = []
        self.chars = self.linked = self.links = 0

    def dump(self) -> list:
        return [self.chars, self.linked, self.links, [[int(r), int(o), [[x, int(m), p.dump() if isinstance(p, Node) else p] for x, m, p in members]] for r, o, members in self.items]]

    @classmethod
    def load(cls, held: list) -> Node:
        node = cls()
        node.chars, node.linked, node.links, items = held
        node.items = [[bool(r), bool(o), [[x, bool(m), cls.load(p) if isinstance(p, list) else p] for x, m, p in members]] for r, o, members in items]
        return node


def digest(text: str) -> str:
    """A short name of a text; equal texts, equal names."""
    plain = " ".join(text.split())
    return plain if len(plain) <= 24 else f"{plain[:12]}~{hashlib.blake2b(plain.encode(), digest_size=6).hexdigest()}"


def same(a: Node | str | None, b: Node | str | None) -> Node | str | None:
    """Two payloads of one label aligned."""
    if isinstance(a, Node):
        return align(a, b)
    return a if a == b else None


def unite(members: list[list], more: list[list], apart: bool) -> list[list]:
    """Members of two groups as one; with apart, all may be missing."""
    at = {m[0]: m for m in members}
    known = [m[0] for m in more if m[0] in at]
    swapped = known != sorted(known, key=[m[0] for m in members].index)
    theirs = {m[0] for m in more}
    for m in members:
        m[1] = m[1] or apart or swapped or m[0] not in theirs
    for x, optional, payload in more:
        if x in at:
            at[x][1] = at[x][1] or optional
            at[x][2] = same(at[x][2], payload)
        else:
            members.append([x, True, payload])
    return members


def align(a: Node, b: Node) -> Node:
    """The least pattern of this form that takes what a takes and what b takes.

    b's items are walked along a's. An item that a lacks goes in where the walk stands, as optional; an item that joins
    several of a's, or stands before where the walk is, makes them one repeated group."""
    a.chars, a.linked, a.links = a.chars + b.chars, a.linked + b.linked, a.links + b.links
    items, at, met = a.items, -1, set()
    for repeated, optional, members in b.items:
        names = {m[0] for m in members}
        where = [k for k, item in enumerate(items) if any(m[0] in names for m in item[2])]
        if not where:
            at += 1
            items.insert(at, [repeated, True, members])
            met.add(id(items[at]))
            continue
        low, high = min(where), max(where)
        low, high = (min(low, at), max(high, at)) if low < at else (low, high)
        if low == at >= 0 and id(items[at]) in met:  # the group was met before: it repeats
            repeated = True
            apart = True
        else:
            apart = low < high
        group = items[low]
        for other in items[low + 1 : high + 1]:
            group[2] = unite(group[2], other[2], True)
        group[2] = unite(group[2], members, apart)
        group[0], group[1] = group[0] or repeated or low < high, group[1] or optional
        if group[0] and any(m[0] == TEXT for m in group[2]):
            for m in group[2]:
                m[2] = None if m[0] == TEXT else m[2]
        del items[low + 1 : high + 1]
        at = low
        met.add(id(group))
    for item in items:
        if id(item) not in met:
            item[1] = True
    return narrow(a)


def narrow(node: Node) -> Node:
    """Leaves out class words where a pattern has too many labels."""
    if sum(len(item[2]) for item in node.items) <= WIDTH:
        return node
    sequence = [[bare(m[0]), m[2]] for item in node.items for m in item[2]]
    if len({x for x, _ in sequence}) == len(sequence):
        return node
    node.items = folded(sequence)
    for item in node.items:
        item[1] = True
        for m in item[2]:
            m[1] = True
    return node


def folded(sequence: list[list]) -> list[list]:
    """Items of one element's children in order: labels that come again make a repeated group with all between."""
    first, last = {}, {}
    for k, (x, _) in enumerate(sequence):
        first.setdefault(x, k)
        last[x] = k
    items, k = [], 0
    while k < len(sequence):
        end, j = last[sequence[k][0]], k
        while j <= end:
            end = max(end, last[sequence[j][0]])
            j += 1
        run = sequence[k : end + 1]
        order: dict[str, int] = {}
        payload: dict[str, Node | str | None] = {}
        seen: dict[str, int] = {}
        rounds, before = 1, -1
        for x, p in run:
            place = order.setdefault(x, len(order))
            if place <= before:
                rounds += 1
            before = place
            seen[x] = seen.get(x, 0) + 1
            payload[x] = same(payload[x], p) if x in payload else p
        repeated = len(run) > len(order)
        members = [[x, seen[x] < rounds, None if repeated and x == TEXT else payload[x]] for x in order]
        items += [[True, False, members]] if repeated else [[False, False, [m]] for m in members]
        k = end + 1
    return items


def pattern(text: str) -> Node:
    """The pattern of one page: its own repetitions are folded as elements end."""
    stack: list[tuple[str, Node, list[list]]] = [("", Node(), [])]
    deeper = links = 0
    for kind, own in tokens(text):
        if kind == TEXT:
            if size := len(own.strip()):
                _, node, children = stack[-1]
                node.chars, node.linked = node.chars + size, node.linked + size * (links > 0)
                if children and children[-1][0] == TEXT:  # only a comment stands between
                    children[-1][1] = None
                else:
                    children.append([TEXT, digest(own)])
            continue
        links += (element(own) == "a") * (1 if kind == "<" else -1)
        if kind == "<" and len(stack) <= DEPTH:
            stack.append((own, Node(), []))
        elif kind == "<":
            deeper += 1
        elif deeper:
            deeper -= 1
        else:
            name, node, children = stack.pop()
            node.items, node.links = folded(children), int(element(name) == "a")
            stack[-1][2].append([name, narrow(node)])
    _, node, children = stack[0]
    node.items = folded(children)
    return narrow(node)


def regex(node: Node) -> str:
    """A wrapper as a regular expression over <label>, # and </label>; constant texts are shown as slots."""
    out = []
    for repeated, optional, members in node.items:
        group = ""
        for x, m, p in members:
            own = re.escape(TEXT) if x == TEXT else f"{re.escape(f'<{x}>')}{regex(p)}{re.escape(f'</{x}>')}"
            group += f"(?:{own})?" if m else own
        out.append(f"(?:{group}){'*' if repeated and optional else '+' if repeated else '?' if optional else ''}")
    return "".join(out)


WRAPPERS = "host string, wrapper string, pages long"


def _packed(held: dict[str, list]) -> pa.RecordBatch:
    columns = [list(held), [json.dumps(node.dump(), ensure_ascii=False, separators=(",", ":")) for node, _ in held.values()], [n for _, n in held.values()]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["host", "wrapper", "pages"])


def _inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for batch in slices(batches, "html"):
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own = pattern(text)
            if host in held:
                held[host] = [align(held[host][0], own), held[host][1] + 1]
            else:
                held[host] = [own, 1]
        if len(held) > HOSTS:
            yield _packed(held)
            held = {}
    yield _packed(held)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each host, which come together, as one."""
    host, node, pages = None, None, 0
    for batch in batches:
        done: list[tuple[str, list]] = []
        for name, wrapper, n in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "pages")), strict=True):
            own = Node.load(json.loads(wrapper))
            if node is not None and name == host:
                node, pages = align(node, own), pages + n
                continue
            if node is not None:
                done.append((host, [node, pages]))
            host, node, pages = name, own, n
        yield _packed(dict(done))
    if node is not None:
        yield _packed({host: [node, pages]})


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null is empty) and host, from the url; without one the host is empty."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def wrappers(pages: DataFrame, salts: int = 16) -> DataFrame:
    """host, wrapper, pages: one row a host."""
    first = with_host(pages).select("host", "html").mapInArrow(_inferred, WRAPPERS)
    salted = first.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    second = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").select("host", "wrapper", "pages").mapInArrow(_aligned, WRAPPERS)
    return scratch(second.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_aligned, WRAPPERS), "host-wrappers")


#: Which text of a page counts: that of the first of these that the page has.
ARTICLE, MAIN, CONTENT, REGION, REST = range(5)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Slots:
    """What a wrapper's element means: the levels its texts belong to, and its children by label."""

    __slots__ = ("children", "heads", "levels", "text")

    def __init__(self, levels: frozenset[int], heads: bool):
        self.levels, self.heads = levels, heads
        self.children: dict[str, Slots | None] = {}
        self.text = levels  # of its own texts

    def child(self, name: str) -> Slots | None:
        """The place of a child; a wrapper of the host knows each by its label, or by that without class words."""
        return self.children[name] if name in self.children else self.children[bare(name)]


def _total(node: Node) -> tuple[int, int, int]:
    """Characters, linked characters and links in a subtree, without what is marked as outside."""
    chars, linked, links = node.chars, node.linked, node.links
    for _, _, members in node.items:
        for x, _, p in members:
            if isinstance(p, Node) and bare(x)[-1] not in "!~":
                chars, linked, links = (s + t for s, t in zip((chars, linked, links), _total(p), strict=True))
    return chars, linked, links


def _region(node: Node) -> Node:
    """The lowest element that holds nine tenths of the text, short of single blocks."""
    while True:
        inner = [(x, p) for _, _, members in node.items for x, _, p in members if isinstance(p, Node) and bare(x)[-1] not in "!~"]
        most = max(inner, key=lambda m: _total(m[1])[0], default=None)
        if most is None or element(most[0]) not in BLOCK or element(most[0]) in {"p", "li", "td", "pre", *HEADINGS} or _total(most[1])[0] < 0.9 * _total(node)[0]:
            return node
        node = most[1]


def slots(node: Node, pages: int) -> Slots:
    """The meaning of each of a wrapper's places."""
    region = _region(node)

    def differs(own: Node) -> bool:
        return any(p is None or (isinstance(p, Node) and bare(x)[-1] not in "!~" and differs(p)) for _, _, members in own.items for x, _, p in members)

    varied = pages >= TEMPLATE_PAGES and differs(region)

    def walk(own: Node, levels: frozenset[int], heads: bool) -> Slots:
        if own is region:
            levels = levels | {REGION}
        out = Slots(levels, heads)
        for _, _, members in own.items:
            for x, _, p in members:
                if x == TEXT:
                    if p is not None and varied:
                        out.text = levels - {REGION}
                    continue
                name, mark = element(x), bare(x)[-1]
                inside = ARTICLE in levels
                if mark == "!" or (mark == "~" and not inside):
                    out.children[x] = None
                    continue
                below = levels
                if name == "article":
                    below = below | {ARTICLE}
                elif name == "main":
                    below = below | {MAIN}
                elif mark == "*":
                    below = below | {CONTENT}
                if REGION in below and not inside:
                    chars, linked, links = _total(p)
                    if links >= LINKS * pages and linked > LINKED * chars:
                        below = below - {REGION}
                out.children[x] = walk(p, below, (heads or mark == "~") and name not in HEADINGS)
        return out

    return walk(node, frozenset({REST}), False)


@lru_cache(64)
def _slots_of(wrapper: str, pages: int) -> Slots:
    return slots(Node.load(json.loads(wrapper)), pages)


def matched(text: str, wrapper: Slots) -> str:
    """The article of a page that the wrapper takes: blocks in order, one a line."""
    found: dict[int, list[str]] = {level: [] for level in (ARTICLE, MAIN, CONTENT, REGION, REST)}
    parts: dict[int, list[str]] = {level: [] for level in found}

    def end_block() -> None:
        for level, own in parts.items():
            if own and (line := " ".join("".join(own).split())):
                found[level].append(line)
            own.clear()

    stack: list[Slots | None] = [wrapper]
    present = set(wrapper.levels)
    deeper = 0
    for kind, own in tokens(text):
        if kind == TEXT:
            here = stack[-1]
            if here is not None and here.text and not here.heads:
                plain = html.unescape(own)
                for level in here.text:
                    parts[level].append(plain)
            continue
        name = element(own)
        if name in BLOCK:
            end_block()
        elif name == "br" and kind == "<":
            for mine in parts.values():
                if mine:
                    mine.append(" ")
        if kind == "<":
            if len(stack) > DEPTH:
                deeper += 1
            else:
                here = stack[-1]
                stack.append(None if here is None else here.child(own))
                if stack[-1] is not None:
                    present |= stack[-1].levels
        elif deeper:
            deeper -= 1
        else:
            stack.pop()
    end_block()
    return "\n".join(found[min(present)])


EXTRACTED = "page_id long, url string, text string, n_chars long"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        out = [matched(text, _slots_of(wrapper, n)) for text, wrapper, n in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "pages")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages.

    Null or empty html gives an empty text; pages without a url, or with one that isn't absolute, share a host; rows that
    repeat a page_id are judged each by itself; other columns aren't read; no pages give no rows. A page without
    an element of the article's kind gives what the next kind holds, at last all texts that aren't marked as outside; an
    article without text gives an empty one."""
    own = with_host(pages)
    found = wrappers(pages)
    if (found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
        held = own.join(F.broadcast(found), "host")
    else:
        held = join_hot(own, found.withColumn("rows", F.col("pages")), ["host"], "rows", "html")
    return held.select("page_id", "url", "html", "wrapper", "pages").mapInArrow(_extracted, EXTRACTED)


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages whose article has headings and paragraphs only, as those of the tables.
OP11_SQL = r"""
WITH inside AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
cut AS (SELECT page_id, url, string_split_regex(replace(body, '<br>', ' '), '</?(?:p|h1)>') AS parts FROM inside),
plain AS (
  SELECT page_id, url, list_transform(parts, lambda x:
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(?:39|x27);?', '''', 'g'), '&amp;?', '&', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS lines
  FROM cut
)
SELECT page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10))) AS n_chars
FROM plain
"""
