"""HTML extraction by wrapper induction.

A page is parsed into a tree of blocks. The pages of a host are aligned, by simple tree matching,
with two of its pages (those with the least and the greatest hash of their id; a page with the one
it matches better). For every node of a reference page it is counted, over the distinct articles
among all pages of the host, how often the node matched and how often it had the same text: nodes
that nearly always have are template, the others are slots that content varies in. A page is an
article of its own if ``OWN_SHARE`` of its text is on no other page of the host; those that aren't,
copies and near copies, are one article where the longest text that they share is the same, so
copies alone never make an article's text template. What neither reference has is counted by the
labels from the root: a text is also template if nearly all articles with a text at that path have
it, or if nearly all texts at that path are ones that several articles have (a footer in three
languages), on however few pages of the host. Then each page is aligned once more and the text of
its slots is taken, in page order: of its articles, or else of its main element, or else of all.

Slots can vary and still be no article: menus, sidebars, footers and forms by their elements, and
blocks of which a whole class, id or role is a name for such a thing. Names decide only where
elements and the wrapper don't: never on html, body and main; never on a block that holds the only
articles, or most of the text, of the page (as a form around a whole page does), unless it is for
readers' comments; inside an article only names of adverts, sharing and comments; and not at all
where nothing would be left.

Matching is exact at every size and depth. Subtrees of one shape are matched once; children of one
shape at the start and end of two lists match in some best matching; between them a table is filled
row by row and only every n-th row is kept.

References are two small trees for each host. What pages share is found from hashes of their texts;
counts are summed in each task before they are shuffled. A hot host is a skewed side of a join that Spark splits.

Defined results: null html, or none with text, gives an empty text; a null or odd url belongs to
no host and has no template; where all of an article is template it is kept; pages that repeat an
id are extracted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import saved, small_batches
from windrow.sources.scratch import tidied
from windrow.sources.tables import table

#: A node is template if at least this many articles have it, and this share of them with one text.
LEAST_PAGES, SAME_SHARE = 5, 0.9
#: With less of its text on no other page of its host, a page may be a copy.
OWN_SHARE = 0.2
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
#: Elements that hold no main text; the first group also inside a line.
UNWANTED = frozenset("button select option svg iframe object audio video canvas noscript template datalist".split())
UNWANTED_BLOCKS = frozenset("nav aside footer head dialog menu".split())
#: Elements around fields; they may also be around a whole page.
FIELDS = frozenset({"form", "fieldset"})
#: What an opening element closes, and the elements that bound the search for it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
NO_P = frozenset({"html", "body", "head", "td", "th", "caption", "button"})

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_DIGITS = re.compile(r"[0-9]+")
#: Whole names of blocks that are no article, wherever they stand.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion".split())
SHARING = frozenset("share sharing share-button share-buttons share-links social social-share social-links newsletter newsletter-signup".split())
REPLIES = frozenset("comment comments comment-list commentlist comments-area comment-section user-comments respond disqus disqus-thread replies reply".split())
#: Whole names of blocks that are no article where they stand outside of one.
OUTSIDE = frozenset(
    "sidebar side-bar nav navbar navigation menu breadcrumb breadcrumbs cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice notices alert "
    "subscribe popup modal overlay related related-posts toolbar widget widgets login signup search pagination pager skip-link complementary contentinfo "
    "header masthead footer banner topbar top-bar branding site-header site-footer page-header page-footer".split()
)
ANYWHERE = ADVERTS | SHARING | REPLIES
#: Elements that hold the whole page, or its main text.
WHOLE, MAIN = frozenset({"html", "body"}), frozenset({"article", "main"})
#: Why a block is unwanted: it may be spared where its names or fields say so, not where its element does.
BY_NAME, BY_ELEMENT = 1, 2


class Node:
    """A block: its label, the texts and blocks in it, and whether it is unwanted."""

    __slots__ = ("tag", "names", "parts", "bad", "kids", "text", "at", "template", "label", "shape", "size")

    def __init__(self, tag: str, names: frozenset[str], bad: int, label: str = "") -> None:
        self.tag, self.names, self.bad = tag, names, bad
        self.parts: list = []
        self.kids: list[Node] = []
        self.text, self.at, self.template, self.label, self.shape, self.size = "", 0, False, label or tag, 0, 1


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by their names in lower case; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def names_of(found: dict[str, str]) -> frozenset[str]:
    return frozenset(" ".join(found.get(k, "") for k in ("class", "id", "role")).lower().replace("_", "-").split())


def hides(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDING.search(found.get("style", "")))


def parse(html: str, by_names: bool = True) -> Node:
    """The tree of blocks of a page; inline elements dissolve into their text."""
    root = Node("#root", frozenset(), 0)
    stack, inline, pos = [root], None, 0
    open_: dict[str, int] = {}  # how many blocks of a tag are open
    search, n = _TOKEN.search, len(html)

    def close(k: int) -> None:
        for x in stack[k:]:
            open_[x.tag] -= 1
        del stack[k:]

    while pos < n:
        m = search(html, pos)
        if m is None:
            if inline is None:
                stack[-1].parts.append(html[pos:])
            break
        if m.start() > pos and inline is None:
            stack[-1].parts.append(html[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if inline is not None:  # inside an unwanted inline element
            if tag == inline[0] and tag not in VOID:
                inline[1] += -1 if closing else 1
                if not inline[1]:
                    inline = None
            elif closing and tag in BLOCKS:  # it was never closed
                inline = None
            if inline is not None or tag not in BLOCKS:
                continue
        if closing:
            if tag in BLOCKS and open_.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        article = open_.get("article", 0) + open_.get("main", 0)
        found = attributes(attrs) if attrs and not attrs.isspace() else {}
        names = names_of(found) if found else frozenset()
        hidden = bool(found) and tag not in WHOLE and hides(found)
        named_bad = by_names and bool(names) and tag not in WHOLE and tag != "main" and not names.isdisjoint(REPLIES if tag == "article" else ANYWHERE if article else ANYWHERE | OUTSIDE)
        if tag not in BLOCKS:
            if tag == "br":
                stack[-1].parts.append(" ")
            elif (tag in UNWANTED or hidden or (named_bad and not names.isdisjoint(ADVERTS | SHARING))) and tag not in VOID and not attrs.endswith("/"):
                inline = [tag, 1]
            continue
        if tag in CLOSES:
            closes, bound = CLOSES[tag]
            if any(map(open_.get, closes)):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in bound:
                        break
                    if stack[k].tag in closes:
                        close(k)
                        break
        elif open_.get("p") and tag not in ("td", "th", "caption"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in NO_P:
                    break
        bad = BY_ELEMENT if hidden or tag in UNWANTED_BLOCKS or (not article and tag == "header") else BY_NAME if named_bad or tag in FIELDS else 0
        node = Node(tag, names, bad, ".".join([tag, *sorted(_DIGITS.sub("#", x) for x in names)]) if names else tag)
        stack[-1].parts.append(node)
        if tag not in VOID:
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    return root


def spare(root: Node) -> Node:
    """Keep the blocks unwanted by name or for their fields that hold the only articles of the page,
    or most of its text with no article beside them."""
    every, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.bad != BY_ELEMENT:
            every.append(x)
            todo += [k for k in x.parts if not isinstance(k, str)]
    if not any(x.bad for x in every):
        return root
    size: dict[int, int] = {}
    mains: dict[int, int] = {}
    for x in reversed(every):
        kids = [k for k in x.parts if not isinstance(k, str)]
        size[id(x)] = sum(len(k.strip()) for k in x.parts if isinstance(k, str)) + sum(size.get(id(k), 0) for k in kids)
        mains[id(x)] = (x.tag in MAIN and not x.bad) + sum(mains.get(id(k), 0) for k in kids)
    for x in every:
        if x.bad and mains[id(x)] == mains[id(root)] and (mains[id(x)] or 2 * size[id(x)] > size[id(root)]) and x.names.isdisjoint(REPLIES):
            x.bad = 0
    return root


def finish(node: Node) -> Node:
    """Turn the parts of wanted blocks into children, texts decoded and with single spaces."""
    todo = [node]
    while todo:
        x = todo.pop()
        run: list[str] = []
        for part in [*x.parts, None]:
            if isinstance(part, str):
                run.append(part)
                continue
            if run:
                raw = "".join(run)
                if text := " ".join((entities.unescape(raw) if "&" in raw else raw).split()):
                    leaf = Node("#text", frozenset(), 0)
                    leaf.text = text
                    x.kids.append(leaf)
                run = []
            if part is not None and not part.bad:
                x.kids.append(part)
                todo.append(part)
        x.parts = []
        if len(x.kids) == 1 and x.kids[0].tag == "#text":  # a block of text alone is a leaf
            x.text, x.kids = x.kids[0].text, []
    return node


def nodes(root: Node) -> list[Node]:
    """All blocks in page order."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.kids)
    return out


def shaped(root: Node) -> Node:
    """Number all blocks in page order, and name their shapes: subtrees of equal labels have one."""
    every = nodes(root)
    for k, x in enumerate(every):
        x.at = k
    for x in reversed(every):
        x.size = 1 + sum(k.size for k in x.kids)
        x.shape = hash((x.label, *(k.shape for k in x.kids)))
    return root


def tree(html: str | None) -> Node:
    root = finish(spare(parse(html or "")))
    if not any(x.text for x in nodes(root)):
        root = finish(parse(html or "", by_names=False))
    return shaped(root)


def as_json(root: Node) -> str:
    """A reference tree: for each block in page order its label, hash of its text, and number of children."""
    every = nodes(root)
    return json.dumps([[x.label for x in every], [zlib.crc32(x.text.encode(errors="replace")) if x.text else 0 for x in every], [len(x.kids) for x in every]])


def reference(text: str) -> Node:
    stack: list[tuple[Node, int]] = []
    root = None
    for label, crc, kids in zip(*json.loads(text), strict=True):
        x = Node("", frozenset(), 0, label)
        x.text = crc
        if root is None:
            root = x
        else:
            while len(stack[-1][0].kids) == stack[-1][1]:
                stack.pop()
            stack[-1][0].kids.append(x)
        stack.append((x, kids))
    return shaped(root)


def _ends(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many children of one shape two lists have at their start, and then at their end."""
    most = min(len(a), len(b))
    n = next((k for k in range(most) if a[k].shape != b[k].shape), most)
    m = next((k for k in range(most - n) if a[-1 - k].shape != b[-1 - k].shape), most - n)
    return n, m


class _Table:
    """Best matchings of the first i of children ``a`` and the first j of ``b``, row by row."""

    def __init__(self, a: list[Node], b: list[Node], weight: Callable[[Node, Node], int]) -> None:
        self.a, self.n = a, len(b)
        shapes: dict[int, int] = {}
        at = np.array([shapes.setdefault(y.shape, len(shapes)) for y in b])
        firsts = list({y.shape: y for y in reversed(b)}.values())
        firsts.sort(key=lambda y: shapes[y.shape])
        self.weights = {x.shape: np.array([weight(x, y) for y in firsts], np.int32)[at] for x in {x.shape: x for x in a}.values()}
        self.step = math.isqrt(len(a)) + 1
        self.kept = []
        row = np.zeros(self.n + 1, np.int32)
        for i in range(len(a)):
            if i % self.step == 0:
                self.kept.append(row)
            row = self.after(row, i)
        self.best = int(row[-1])

    def after(self, row: np.ndarray, i: int) -> np.ndarray:
        out = row.copy()
        np.maximum(out[1:], row[:-1] + self.weights[self.a[i].shape], out=out[1:])
        return np.maximum.accumulate(out)

    def pairs(self) -> list[tuple[int, int]]:
        out, j = [], self.n
        for k in range(len(self.kept) - 1, -1, -1):
            first = k * self.step
            rows = [self.kept[k]]
            for i in range(first, min(first + self.step, len(self.a))):
                rows.append(self.after(rows[-1], i))
            for i in range(len(rows) - 1, 0, -1):
                j = int(np.searchsorted(rows[i][: j + 1], rows[i][j]))  # the first place with as much
                if j and rows[i - 1][j] < rows[i][j]:
                    j -= 1
                    out.append((first + i - 1, j))
        return out


def _weight(memo: dict[tuple[int, int], int], x: Node, y: Node) -> int | None:
    """Size of the largest matching of two trees where it is plain or known, else None."""
    if x.label != y.label:
        return 0
    if x.shape == y.shape:
        return x.size
    if not x.kids or not y.kids:
        return 1
    return memo.get((x.shape, y.shape))


def matching(a: Node, b: Node, memo: dict[tuple[int, int], int]) -> int:
    """Size of the largest top-down matching of two trees that keeps the order of siblings."""
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        if _weight(memo, p, q) is not None:
            todo.pop()
            continue
        n, m = _ends(p.kids, q.kids)
        x, y = p.kids[n : len(p.kids) - m], q.kids[n : len(q.kids) - m]
        size = 1 + sum(k.size for k in p.kids[:n]) + sum(k.size for k in p.kids[len(p.kids) - m :])
        if x and y:
            once, other = {k.shape: k for k in x}.values(), {k.shape: k for k in y}.values()
            open_ = [(s, t) for s in once if s.kids for t in other if _weight(memo, s, t) is None]
            if open_:
                todo += open_
                continue
            size += _Table(x, y, lambda s, t: _weight(memo, s, t)).best
        memo[p.shape, q.shape] = size
        todo.pop()
    return _weight(memo, a, b)


def aligned(a: Node, b: Node, memo: dict[tuple[int, int], int] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: its size, and the pairs of nodes that it aligns."""
    memo = {} if memo is None else memo
    size, out, todo = matching(a, b, memo), [], [(a, b)]
    while todo:
        p, q = todo.pop()
        if p.label != q.label:
            continue
        out.append((p, q))
        n, m = _ends(p.kids, q.kids)
        todo += zip(p.kids[:n], q.kids[:n], strict=True)
        todo += zip(p.kids[len(p.kids) - m :], q.kids[len(q.kids) - m :], strict=True)
        x, y = p.kids[n : len(p.kids) - m], q.kids[n : len(q.kids) - m]
        if x and y:
            todo += [(x[i], y[j]) for i, j in _Table(x, y, lambda s, t: matching(s, t, memo)).pairs()]
    return size, out


def best_alignment(page: Node, refs: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
    """Number of the reference that the page matches best, and the aligned nodes."""
    memo: dict[tuple[int, int], int] = {}
    sizes = [matching(page, r, memo) for r in refs]
    k = max(range(len(refs)), key=lambda k: (sizes[k], -k))
    return k, aligned(page, refs[k], memo)[1]


def main_text(root: Node) -> str:
    """The texts that aren't template of the articles, or else the main element, or else of all, a line for each."""
    for tag in ("article", "main", "#root"):
        inside, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == tag:
                inside += nodes(x)
            else:
                todo += reversed(x.kids)
        if any(x.text for x in inside):
            return "\n".join([x.text for x in inside if x.text and not x.template] or [x.text for x in inside if x.text])
    return ""


_MATCHED = pa.list_(pa.struct([("ref", pa.int32()), ("at", pa.int32()), ("same", pa.bool_())]))
_LEAVES = pa.list_(pa.struct([("path", pa.int64()), ("leaf", pa.int64()), ("len", pa.int32())]))


def named(root: Node) -> list[tuple[Node, int, int]]:
    """The texts of a page with a hash of their labels from the root, and one of it and the text."""
    out, todo = [], [(root, b"")]
    while todo:
        x, above = todo.pop()
        path = hashlib.blake2b(x.label.encode(errors="replace"), digest_size=8, key=above).digest()
        if x.text:
            leaf = hashlib.blake2b(x.text.encode(errors="replace"), digest_size=8, key=path).digest()
            out.append((x, int.from_bytes(path, "big", signed=True), int.from_bytes(leaf, "big", signed=True)))
        todo += [(k, path) for k in x.kids]
    return out


def articles(seen: DataFrame) -> DataFrame:
    """``page, article`` of the pages ``h, page, total, leaves`` that aren't the only one of an article."""
    texts = seen.select("h", "page", "total", F.explode("leaves").alias("x")).select("h", "page", "total", "x.*")
    shared = texts.groupBy("h", "leaf").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.count("*").alias("pages")).filter("a <> b")
    sizes = seen.groupBy("h").agg(F.count("*").alias("all"))
    shared = shared.join(sizes, "h").select("h", "leaf", (F.col("pages") < SAME_SHARE * F.col("all")).alias("some"))
    had = texts.join(shared, ["h", "leaf"]).groupBy("page").agg(F.first("total").alias("total"), F.collect_set(F.struct("len", "leaf", "some")).alias("x"))
    length = F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["len"])
    longest = F.array_max(F.filter("x", lambda x: x["some"]))["leaf"]
    near = had.filter(length > (1 - OWN_SHARE) * F.col("total")).select("page", longest.alias("article")).filter("article IS NOT NULL")
    same = seen.groupBy("page").count().filter("count > 1").select("page", F.lit(None).cast("long").alias("article"))
    both = near.unionAll(same).groupBy("page").agg(F.coalesce(F.max("article"), F.col("page")).alias("article"))
    return saved(both, "articles")


def _by_article(rows: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """``n, same`` by ``keys``: in how many articles they are, and in how many with the same text."""
    d = rows.join(grouped, "page", "left").groupBy(*keys, "article").agg(F.count("*").alias("n"), F.sum(F.col("same").cast("double")).alias("same"))
    one = F.col("article").isNotNull()
    d = d.select(*keys, F.when(one, 1).otherwise(F.col("n")).alias("n"), F.when(one, F.col("same") / F.col("n")).otherwise(F.col("same")).alias("same"))
    return d.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("same").alias("same"))


def _host(url: str) -> F.Column:
    return F.lower(F.nullif(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


@tidied
def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text`` of every page."""
    small_batches(pages.sparkSession)
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(url_col).alias("host"))
    kind = dict(p.dtypes)["id"]
    key = F.struct(F.xxhash64("id", "url").alias("h"), "id", "url")
    ends = p.filter(F.col("host").isNotNull()).groupBy("host").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    picked = ends.select("host", F.explode(F.array_distinct(F.array("a", "b"))).alias("r")).select("host", F.col("r.id").alias("rid"), F.col("r.url").alias("rurl"))
    picked = saved(picked, "references")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_json(tree(h)) for h in b.column(1).to_pylist()])], ["host", "tree"])

    found = p.select("id", "url", "html").join(picked, F.col("id").eqNullSafe(F.col("rid")) & (F.col("url") == F.col("rurl"))).select("host", "html")
    refs = found.mapInArrow(trees, "host string, tree string").groupBy("host").agg(F.slice(F.sort_array(F.collect_set("tree")), 1, 2).alias("trees"))
    refs = saved(refs, "reference-trees")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, list[Node]] = {}
        for b in batches:
            totals, matched, found = [], [], []
            for host, html, texts in zip(*(b.column(k).to_pylist() for k in ("host", "html", "trees")), strict=True):
                if host not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[host] = [reference(t) for t in texts]
                root = tree(html)
                k, pairs = best_alignment(root, made[host])
                matched.append([{"ref": k, "at": r.at, "same": zlib.crc32(x.text.encode(errors="replace")) == r.text} for x, r in pairs if r.text and x.text])
                own = {leaf: {"path": path, "leaf": leaf, "len": len(x.text)} for x, path, leaf in named(root)}
                found.append(list(own.values()))
                totals.append(sum(x["len"] for x in own.values()))
            arrays = [b.column("h"), b.column("page"), pa.array(totals, pa.int64()), pa.array(matched, _MATCHED), pa.array(found, _LEAVES)]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "page", "total", "matched", "leaves"])

    keyed = p.withColumns({"h": F.xxhash64("host"), "page": F.xxhash64("host", "html")}).join(refs, "host").select("h", "page", "host", "html", "trees")
    seen = saved(keyed.mapInArrow(align, "h long, page long, total long, matched array<struct<ref int, at int, same boolean>>, leaves array<struct<path long, leaf long, len int>>"), "aligned")
    grouped = articles(seen)
    often = (F.col("n") >= LEAST_PAGES) & (F.col("same") >= SAME_SHARE * F.col("n"))
    sure = _by_article(seen.select("h", "page", F.explode("matched").alias("m")).select("h", "page", "m.*"), grouped, ["h", "ref", "at"]).filter(often)
    template = sure.groupBy("h").agg(F.collect_set(F.struct("ref", "at")).alias("template"))
    yes = F.lit(True).alias("same")
    paths = _by_article(seen.select("h", "page", F.explode(F.array_distinct("leaves.path")).alias("path"), yes), grouped, ["h", "path"])
    texts = _by_article(seen.select("h", "page", F.explode("leaves").alias("x"), yes).select("h", "page", "x.path", "x.leaf", "same"), grouped, ["h", "path", "leaf"])
    several = F.col("same") >= LEAST_PAGES
    shares = texts.groupBy("h", "path").agg(F.sum("same").alias("all"), F.sum(F.when(several, F.col("same")).otherwise(0)).alias("repeated"))
    places = paths.select("h", "path", "n").join(shares.filter("repeated > 0"), ["h", "path"])
    always = (F.col("same") >= SAME_SHARE * F.col("n")) | (F.col("repeated") >= SAME_SHARE * F.col("all"))
    fixed = texts.filter(several).drop("n").join(places, ["h", "path"]).filter(always)
    fixed = fixed.groupBy("h").agg(F.collect_set("leaf").alias("fixed"))
    wrappers = refs.withColumn("h", F.xxhash64("host")).join(template, "h", "left").join(fixed, "h", "left").drop("h")
    wrappers = saved(wrappers.filter("template IS NOT NULL OR fixed IS NOT NULL"), "wrappers")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple[list[Node], set[tuple[int, int]], set[int]]] = {}
        for b in batches:
            out = []
            for html, host, texts, template, fixed in zip(*(b.column(k).to_pylist() for k in ("html", "host", "trees", "template", "fixed")), strict=True):
                root = tree(html)
                if texts:
                    if host not in made:
                        if len(made) > 1000:
                            made.clear()
                        made[host] = [reference(t) for t in texts], {(x["ref"], x["at"]) for x in template or []}, set(fixed or [])
                    refs, sure, always = made[host]
                    k, pairs = best_alignment(root, refs)
                    for x, r in pairs:
                        x.template = (k, r.at) in sure and zlib.crc32(x.text.encode(errors="replace")) == r.text
                    for x, _, leaf in named(root) if always else []:
                        x.template = x.template or leaf in always
                out.append(main_text(root))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    return p.join(wrappers, "host", "left").select("id", "url", "html", "host", "trees", "template", "fixed").mapInArrow(take, f"id {kind}, url string, text string")


def op4_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = extract(table(spark, sf_dir, "pages"))
    return p.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
