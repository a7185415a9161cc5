"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree, whose nodes are paths of block elements with their classes; the pages of
all hosts are merged into another.  A node is on m pages.  Its presentations are the sequences of its child elements on
them, its contents the texts in it.  A text that n of the m pages have at that node has the importance 1 - log n, to
the base m + 2: near 0 if all have it, and 1 if one has.  A node's presentation importance is the entropy of its k
presentations to the same base.  On a page, an element's composite importance is
(1 - g**k) * presentation importance + g**k * the mean of the composite importances of its children and texts, g = 0.9.
(The base counts two more pages, on which nothing repeats, so that few pages prove little.)

An element is of low importance if its composite importance is under log 2 to the base m + 2, where a text is if over
half of m + 2 pages have it.  Low texts go, and low elements with all below, unless most of the texts in them aren't low.
Either tree may say so, the host's or that of all hosts.  The frame (html, body, main, article) and headings never go.
Pages of a host with the same main text are one page, so copies of an article don't make it look like a template.

What HTML itself says comes first: text outside the body, of scripts, styles, forms, navigation, asides, headers and
footers, of hidden elements, of elements with such a role (ARIA), and of articles inside articles, which are comments, is
never main text; where a page has articles (or else a main element), only those hold main text.  Names of classes say
nothing but where a node is.

A page meets the counts of its nodes by joins on host, node and content, in which very frequent keys are broadcast, so
no row holds a host's tree and no task a host's pages.

Defined cases: null or empty html gives an empty text, a null url the host "".  Unclosed and misplaced tags are read
as browsers do in the common cases; a cut-off page is read as far as it goes, and nesting costs time and memory in
proportion to its depth.  Character references are decoded.  A page with nothing left has an empty text.  Repeated rows
give repeated results.  Whole pages are read.  Only the named columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, in_batches, stored

DECAY = 0.9
#: The tree of all hosts, which is no host's name.
ALL = "*"

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>?", re.S)
NAMED = re.compile(r"""\b(class|role|hidden|aria-hidden)\s*=?\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""", re.I)

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select canvas audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
MATHS = frozenset("math merror mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
NEVER = frozenset("head nav aside header footer form button fieldset dialog menu".split())
ROLES = frozenset("alert alertdialog banner comment complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FRAME = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element's start closes these open ones, up to the named borders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Element:
    """A block element of a page: its node in the tree, and what it holds in order: elements, and texts by number."""

    __slots__ = ("tag", "node", "parent", "inside", "label", "never", "article", "main")

    def __init__(self, tag: str, label: str, parent: Element | None, node: int) -> None:
        self.tag, self.label, self.parent, self.node, self.inside = tag, label, parent, node, []
        self.never = self.article = self.main = False

    def shown(self) -> int:
        """Its presentation: the labels of its child elements, of which repeated ones count once."""
        labels = [x.label for x in self.inside if isinstance(x, Element)]
        return _hash(" ".join(a for a, b in zip(labels, [None, *labels]) if a != b))


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class Page:
    """Elements and text blocks of one page, read in one pass."""

    def __init__(self, source: str) -> None:
        self.elements = [Element("", "", None, 0)]
        #: (element, text)
        self.blocks: list[tuple[Element, str]] = []
        self._stack = [self.elements[0]]
        self._text: list[str] = []
        self._read(source)
        open_ = [e for e, _ in self.blocks if not e.never]
        article, main = any(e.article for e in open_), any(e.main for e in open_)
        #: Numbers of the blocks that HTML itself takes for main text.
        self.wanted = [i for i, (e, _) in enumerate(self.blocks) if not e.never and (e.article if article else e.main or not main)]

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            self._text.clear()
            if text:
                self._stack[-1].inside.append(len(self.blocks))
                self.blocks.append((self._stack[-1], text))

    def _open(self, tag: str, attributes: str) -> None:
        above = self._stack[-1]
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMED.finditer(attributes)} if attributes else {}
        classes = [re.sub(r"\d+", "#", c) for c in sorted(named.get("class", "").split())]
        label = ".".join([tag, *classes])
        new = Element(tag, label, above, _hash(f"{above.node}>{label}"))
        hidden = "hidden" in named and tag != "body" or named.get("aria-hidden", "").lower() == "true"
        comment = tag == "article" and above.article
        new.never = above.never or tag in NEVER or hidden or comment or (tag not in FRAME and not ROLES.isdisjoint(named.get("role", "").lower().split()))
        new.article, new.main = above.article or tag == "article", above.main or tag == "main"
        above.inside.append(new)
        self.elements.append(new)
        self._stack.append(new)

    def _close_to(self, tags: set[str], borders: set[str]) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag in tags:
                self._flush()
                del self._stack[i:]
                return
            if self._stack[i].tag in borders:
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self._text.append(source[at:])
                break
            if m.start() > at:
                self._text.append(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag in INLINE or tag in MATHS:
                if tag == "br" or tag == "img":
                    self._text.append(" ")
                continue
            if tag in RAW:
                if not m[1] and not m[3].endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else n
                continue
            self._flush()
            if m[1]:
                self._close_to({tag}, {"article", "body"} if tag == "p" else set())
            else:
                if tag in CLOSES_P:
                    self._close_to({"p"}, {"article", "section", "div", "td", "li", "body", "main"})
                if tag in CLOSES:
                    self._close_to(*CLOSES[tag])
                if tag not in VOID:
                    self._open(tag, m[3])
        self._flush()

    def main(self) -> int:
        """What tells pages of a host apart: the text that HTML takes for main text."""
        return _hash("\n".join(self.blocks[i][1] for i in self.wanted))

    def features(self) -> list[tuple[int, int, int, int]]:
        """(number, node, content, kind) of the wanted blocks (kind 0) and of the elements that hold such (kind 1)."""
        out, seen = [], set()
        for i in self.wanted:
            e, text = self.blocks[i]
            out.append((i, e.node, _hash(text), 0))
            while e is not None and e.parent is not None and id(e) not in seen:
                seen.add(id(e))
                if e.tag not in FRAME and e.tag not in HEADINGS:
                    out.append((-1, e.node, e.shown(), 1))
                e = e.parent
        return out

    def low(self, texts: dict[int, tuple[int, int]], nodes: dict[int, tuple[float, int, int]]) -> set[int]:
        """The wanted blocks of low importance in one tree; ``texts`` has n and m of blocks by number, ``nodes`` entropy, k and m by node."""
        wanted = set(self.wanted)
        low = {i for i in wanted if i in texts and self.blocks[i][0].tag not in HEADINGS and _low(1 - math.log(texts[i][0]) / math.log(texts[i][1] + 2), texts[i][1])}
        if nodes:
            low |= self._low_branches(wanted, low, texts, nodes)
        return low

    def text(self, *trees: tuple[dict, dict]) -> str:
        low = set().union(*(self.low(*tree) for tree in trees))
        return "\n".join(self.blocks[i][1] for i in self.wanted if i not in low)

    def _low_branches(self, wanted: set[int], low: set[int], texts: dict, nodes: dict) -> set[int]:
        """The blocks below elements of low importance; elements are listed from the top, so below comes first in reverse."""
        worth: dict[int, tuple[float, int, int]] = {}  # composite importance, blocks, low ones among them
        gone: set[int] = set()
        for e in reversed(self.elements):
            parts, blocks, lows = [], 0, 0
            for x in e.inside:
                if isinstance(x, Element):
                    if id(x) in worth:
                        value, b, n = worth[id(x)]
                        parts.append(value)
                        blocks, lows = blocks + b, lows + n
                elif x in wanted:
                    n, m = texts.get(x, (1, 1))
                    parts.append(1 - math.log(n) / math.log(m + 2))
                    blocks, lows = blocks + 1, lows + (x in low)
            if parts:
                value = sum(parts) / len(parts)
                if e.node in nodes and e.tag not in FRAME and e.tag not in HEADINGS:
                    entropy, k, m = nodes[e.node]
                    value = (1 - DECAY**k) * entropy + DECAY**k * value
                    if _low(value, m) and 2 * lows >= blocks:
                        gone.add(id(e))
                worth[id(e)] = value, blocks, lows
        out: set[int] = set()
        if gone:
            inside: set[int] = set()
            for e in self.elements:
                if id(e) in gone or e.parent is not None and id(e.parent) in inside:
                    inside.add(id(e))
            out = {i for i in wanted if id(self.blocks[i][0]) in inside and self.blocks[i][0].tag not in HEADINGS}
        return out


def _low(importance: float, m: int) -> bool:
    return importance < math.log(2) / math.log(m + 2) - 1e-12


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, source in enumerate(batch.column(3).to_pylist()):
            if source:
                page = Page(source)
                main = page.main()
                for feature in page.features():
                    at.append(i)
                    rows.append((*feature, main))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        made = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
        took = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(j).take(took) for j in range(3)), *made], ["k1", "k2", "host", "number", "node", "content", "kind", "main"])


def host_of(url: str | Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


KEY = ["k1", "k2"]


def _keyed(pages: DataFrame) -> DataFrame:
    """k1, k2 (hashes of host and html, by which equal pages of a host are one) and host beside the page's columns."""
    host = host_of("url")
    return pages.withColumns({"k1": F.xxhash64(host, "html"), "k2": F.xxhash64(F.lit("b"), host, F.col("html")), "host": host})


def style_tree(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the features of all pages (host, node, content, kind, main): texts (host, node, content, n, m) on several pages, and nodes (host, node, entropy, k, m).

    Counts are of pages with different main texts; the host :data:`ALL` has those of all.
    """
    every = features.select("host", "node", "content", "kind", "main").distinct()
    every = every.unionByName(every.withColumn("host", F.lit(ALL)).distinct())
    n = stored(every.groupBy("host", "node", "content", "kind").agg(F.count("*").alias("n")), "contents")
    m = every.select("host", "node", "kind", "main").distinct().groupBy("host", "node", "kind").agg(F.count("*").alias("m"))
    m = stored(m, "node-pages")
    texts = n.where("kind = 0 and n > 1").join(m.where("kind = 0"), ["host", "node"]).select("host", "node", "content", "n", "m")
    shown = n.where("kind = 1").groupBy("host", "node").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.log("n")).alias("l"), F.count("*").alias("k"))
    nodes = shown.join(m.where("kind = 1"), ["host", "node"])
    # the entropy of the presentations, of which an element that a page has several times may have several
    entropy = F.greatest((F.log("s") - F.col("l") / F.col("s")) / F.log(F.col("m") + 2), F.lit(0.0))
    return texts, nodes.select("host", "node", entropy.alias("entropy"), "k", "m")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, trees in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            texts.append(main_text(source, trees or []))
        made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["page_id", "url", "text", "n_chars"])


def main_text(source: str | None, found: list[dict]) -> str:
    """``found``: what the trees know of the page: kind, number, node, n, m, k, entropy, and whether of all hosts."""
    if not source:
        return ""
    page = Page(source)
    trees = []
    for of_all in (False, True):
        mine = [x for x in found if x["of_all"] == of_all]
        trees.append(({x["number"]: (x["n"], x["m"]) for x in mine if x["kind"] == 0}, {x["node"]: (x["entropy"], x["k"], x["m"]) for x in mine if x["kind"] == 1}))
    return page.text(*trees)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    pages = _keyed(pages.select("page_id", "url", "html"))
    kinds = "k1 long, k2 long, host string, number int, node long, content long, kind int, main long"
    features = stored(pages.select(*KEY, "host", "html").transform(in_batches, _features, kinds), "page-features")
    texts, nodes = (stored(x, "style-tree") for x in style_tree(features))
    own = features.select(*KEY, "host", "number", "node", "content", "kind").distinct()
    own = own.unionByName(own.withColumn("host", F.lit(ALL)))
    # where no text is low in a tree, nothing goes: only the other pages need to know more of it
    low = stored(texts.where(2 * F.col("n") > F.col("m") + 2), "low-texts")
    pages_of = hot_join(own.where("kind = 0"), low.select("host", "node", "content", "n"), ["host", "node", "content"], "left_semi", low.count(), 64, "n")
    touched = stored(pages_of.groupBy(*KEY, (F.col("host") == ALL).alias("of_all")).agg(F.count("*").alias("lows")), "touched-pages")
    own = own.withColumn("of_all", F.col("host") == ALL)
    own = stored(hot_join(own, touched, [*KEY, "of_all"], "left_semi", touched.count(), 48, "lows"), "touched-features")
    met = hot_join(own.where("kind = 0"), texts, ["host", "node", "content"], "inner", texts.count(), 96, "n")
    met = met.select(*KEY, F.struct("kind", "number", "node", "n", "m", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("entropy"), "of_all").alias("x"))
    branches = nodes.where("m > 2")  # a node on fewer pages can't be of low importance
    there = hot_join(own.where("kind = 1"), branches, ["host", "node"], "inner", branches.count(), 96, "m")
    there = there.select(*KEY, F.struct("kind", "number", "node", F.lit(0).cast("long").alias("n"), "m", "k", "entropy", "of_all").alias("x"))
    found = met.unionByName(there).distinct().groupBy(*KEY).agg(F.collect_list("x").alias("trees"))  # a page's own nodes
    copies = pages.groupBy(*KEY).agg(F.count("*").alias("copies"))
    found = stored(found.join(copies, KEY), "page-trees")
    rows, size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("trees")), F.lit(0))).first()
    out = hot_join(pages, found, KEY, "left", 1, 96 * rows + 96 * size, "copies", size=96 + 96 * F.size("trees"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return out.select("page_id", "url", "html", "trees").transform(in_batches, _extracted, f"page_id {kind}, url string, text string, n_chars long")
