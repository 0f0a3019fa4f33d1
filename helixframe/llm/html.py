"""Main text of web pages by a tree-structured graphical model.

Every element of a page is a variable (content or not) with features of its own; an edge of the tree has a
potential for each pair of labels of parent and child. Sum-product messages pass once upward and once downward,
level by level over all pages of a chunk at once, and give each element's content marginal. Weights are fitted
by gradient ascent on labelled pages: pages that mark their article teach by that mark.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table

FEATURES = 1 << 12
#: Labelled pages learnt from, at most; passes over them; step; pull of weights to zero.
SAMPLE, STEPS, RATE, SHRINK = 1000, 120, 0.5, 1e-4
#: Pages whose elements are worked on together.
PAGES = 400

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HIDDEN = set("head title script style noscript template textarea select option button iframe object svg math canvas audio video".split())
RAW = "script|style|noscript|template|textarea|iframe|title"
#: A new element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in tag names, classes, ids and roles that speak against or for content.
AGAINST = re.compile(r"^(?:ad|ads|advert\w*|promo\w*|sponsor\w*|banner\w*|nav\w*|menu\w*|header|masthead|footer|foot|side\w*|aside|cookie\w*|notice\w*|alert\w*|consent|gdpr|popup|modal|comment\w*|repl(?:y|ies)|form|login|signup|subscri\w*|newsletter|search\w*|share\w*|social\w*|related|recommend\w*|breadcrumb\w*|pagination|pager|widget\w*|toolbar|complementary|contentinfo)$")
FOR = re.compile(r"^(?:article\w*|main|content|post|entry|story|body\w*|text)$")

#: Elements nested deeper hang side by side at this depth, as in browsers.
DEEPEST = 512
#: Against-blocks grafted into each training page's article, at most, and names they may get.
GRAFTS, GRAFT_TAGS, BAD_TAGS = 6, ("div", "section", "ul", "table"), ("aside", "form", "nav", "footer", "header")
GRAFT_NAMES = ("ad", "ads", "advert", "promo", "sponsor", "banner", "nav", "menu", "sidebar", "notice", "cookie", "comments", "comment", "reply", "replies",
               "form", "login", "newsletter", "search", "share", "social", "related", "widget")

NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
RAW_NAME = re.compile(rf"<({RAW})\b", re.I)
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORDS = re.compile(r"[a-z]+|\d+")
BLANK = re.compile(r"[\x20\t\n\r\f\v ]+")


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, tag, attributes) of the markup of a page; kind is open, close, raw (with its content) or skip.

    One pass whatever the page holds: what no ``>`` follows is text, and a place between attributes from which no tag
    can end is met only once."""
    at, size = 0, len(page)
    dead: set[int] = set()  # places outside quotes from which the page ends before the tag does
    unclosed = {'"': size, "'": size}  # from there on no such quote follows

    def tag_end(place: int) -> int:
        """Behind the ``>`` that ends the attributes from ``place`` on, quotes aside; -1 if none does."""
        seen = []
        while place not in dead:
            seen.append(place)
            m = STOP.search(page, place)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            end = page.find(m[0], m.end()) if m.end() < unclosed[m[0]] else -1
            if end < 0:
                unclosed[m[0]] = min(unclosed[m[0]], m.end())
                break
            place = end + 1
        dead.update(seen)
        return -1

    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, "skip", "", ""
            continue
        close = page.find(">", start)
        if close < 0:
            return
        if raw := RAW_NAME.match(page, start):
            tag = raw[1].lower()
            end = RAW_END[tag].search(page, close + 1)
            at = end.end() if end else size
            yield start, at, "raw", tag, page[raw.end():close]
        elif name := NAME.match(page, start):
            end = tag_end(name.end())
            at = end if end >= 0 else close + 1  # a quote that never ends: the tag is passed over
            yield start, at, "skip" if end < 0 else "close" if name[1] else "open", name[2].lower() if end >= 0 else "", page[name.end():at - 1]
        elif page[start + 1:start + 2] in ("!", "?", "/"):
            at = close + 1
            yield start, at, "skip", "", ""
        else:
            at = start + 1
            yield start, start, "skip", "", ""  # a sign in the text


@dataclass
class Tree:
    """Elements of pages in page order: parent (-1 for roots), depth, inline or block, features; pieces of text."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    inline: list[bool] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    #: (element, text); None breaks a block.
    pieces: list[tuple[int, str | None]] = field(default_factory=list)

    def add(self, parent: int, tag: str, attrs: str) -> int:
        names = [tag]
        if attrs:
            names += [w for m in ATTRIBUTE.finditer(attrs) for w in WORDS.findall((m[1] or m[2] or m[3] or "").lower())]
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.inline.append(tag in INLINE)
        self.names.append(names)
        self.tags.append(tag)
        self.own.append(0)
        return len(self.parent) - 1

    def parse(self, page: str) -> None:
        """Append a page; elements that are not closed end with their parent."""
        stack, at = [self.add(-1, "#page", "")], 0
        block = [0]  # of each open element, the place in the stack of the innermost that is not inline
        open_ = Counter()

        def text(piece: str) -> None:
            if piece:
                piece = html.unescape(piece) if "&" in piece else piece
                self.pieces.append((stack[-1], piece))
                self.own[stack[-1]] += len(piece.strip())

        def cut(k: int) -> None:
            open_.subtract(self.tags[i] for i in stack[k:])
            del stack[k:], block[k:]

        def add(tag: str, attrs: str) -> int:
            return self.add(stack[min(len(stack), DEEPEST) - 1], tag, attrs)

        for start, end, kind, tag, attrs in tokens(page):
            if start == end:
                continue
            text(page[at:start])
            at = end
            if not tag:
                continue
            if tag not in INLINE:
                self.pieces.append((stack[-1], None))
            if kind == "raw" or kind == "open" and tag in VOID:
                add(tag, attrs)
            elif kind == "close":
                if open_[tag] > 0:
                    k = len(stack) - 1
                    while self.tags[stack[k]] != tag:
                        k -= 1
                    cut(k)
            else:
                if tag not in INLINE:  # a block ends an open paragraph, with the inline elements in it
                    k = block[-1]
                    if k > 0 and (self.tags[stack[k]] == "p" or self.tags[stack[k]] in ENDS.get(tag, ())):
                        cut(k)
                stack.append(add(tag, attrs))
                block.append(block[-1] if tag in INLINE else len(stack) - 1)
                open_[tag] += 1
        text(page[at:])

    def graft(self, rng: np.random.Generator) -> None:
        """Put blocks that speak against content into the article of the one page held: copies of such blocks of the page,
        some under other such names, and new ones with copies of the article's own paragraphs or a text of their own.
        Blocks without such a name are put there too; they are content."""
        label, _ = self.marked()
        bad = np.array([t not in HIDDEN and any(AGAINST.match(x) for x in names) for t, names in zip(self.tags, self.names, strict=True)])
        inside = np.flatnonzero(label & ~np.array(self.inline))
        below: dict[int, list[int]] = {}
        for i, p in enumerate(self.parent):
            below.setdefault(p, []).append(i)
        tops = np.array([i for i in np.flatnonzero(bad) if not bad[self.parent[i]]], int)
        leaves = np.array([i for i in inside if not any(not self.inline[k] for k in below.get(i, []))], int)

        def put(parent: int, names: list[str], inline: bool, own: int) -> int:
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.inline.append(inline)
            self.names.append(names)
            self.tags.append(names[0])
            self.own.append(own)
            return len(self.parent) - 1

        def copy(top: int, parent: int, names: list[str] | None) -> None:
            to = {top: put(parent, names or self.names[top], self.inline[top], self.own[top])}
            todo = list(below.get(top, []))
            while todo:
                i = todo.pop()
                to[i] = put(to[self.parent[i]], self.names[i], self.inline[i], self.own[i])
                todo += below.get(i, [])

        def against() -> list[str]:
            if rng.random() < 0.4:
                return [str(rng.choice(BAD_TAGS))]
            return [str(rng.choice(GRAFT_TAGS)), str(rng.choice(GRAFT_NAMES))]

        for _ in range(rng.integers(1, GRAFTS + 1) if len(inside) else 0):
            parent = int(rng.choice(inside))
            if len(leaves) and rng.random() < 0.15:  # a block like the others, but for its name
                block = put(parent, [str(rng.choice(GRAFT_TAGS)), f"part{rng.integers(1000)}"], False, 0)
                for leaf in rng.choice(leaves, rng.integers(1, 4)):
                    copy(int(leaf), block, None)
            elif len(tops) and rng.random() < 0.5:
                copy(int(rng.choice(tops)), parent, against() if rng.random() < 0.7 else None)
            elif len(leaves) and rng.random() < 0.4:  # text of the block's own
                put(parent, against(), False, int(rng.integers(10, 300)))
            elif len(leaves):
                block = put(parent, against(), False, 0)
                for leaf in rng.choice(leaves, rng.integers(1, 4)):
                    copy(int(leaf), block, None)

    def extend(self, other: Tree) -> None:
        """Append the elements of another forest (for training; without its text)."""
        n = len(self.parent)
        self.parent += [p + n if p >= 0 else p for p in other.parent]
        for name in ("depth", "inline", "names", "tags", "own"):
            getattr(self, name).extend(getattr(other, name))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.parent), np.array(self.depth), np.array(self.inline)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(feature, element) pairs: names, name groups, parent, text below and its share in links."""
        parent, depth, _ = self.arrays()
        size, linked = np.array(self.own, float), np.array(self.own, float)
        linked[[t != "a" for t in self.tags]] = 0
        for level in levels(depth)[:0:-1]:
            np.add.at(size, parent[level], size[level])
            np.add.at(linked, parent[level], linked[level])
        long = np.minimum(np.log2(size + 1).astype(int), 12)
        dense = np.where(size > 0, np.minimum(linked / np.maximum(size, 1), 1) * 4, 5).astype(int)
        feature, element = [], []
        for i, names in enumerate(self.names):
            mine = ["bias", f"tag {names[0]}", f"under {self.tags[parent[i]] if parent[i] >= 0 else ''}", f"long {long[i]}", f"dense {dense[i]}"]
            for name in names:
                if name != names[0]:
                    mine.append(f"name {name}")
                if AGAINST.match(name):
                    mine.append("against")
                elif FOR.match(name):
                    mine.append("for")
            feature += [crc32(x.encode()) % FEATURES for x in mine]
            element += [i] * len(mine)
        return np.array(feature), np.array(element)

    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """(label, known) by the page's own mark: inside an article and in nothing that speaks against content.
        Elements of a page without an article are not known."""
        n = len(self.tags)
        inside, against, root = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, int)
        has = np.zeros(n, bool)
        for i in range(n):
            p = self.parent[i]
            root[i] = i if p < 0 else root[p]
            # What a whole page is called says what it has, not what it is.
            bad = self.tags[i] in HIDDEN or self.tags[i] not in ("html", "body") and any(AGAINST.match(x) for x in self.names[i])
            inside[i] = (p >= 0 and inside[p]) or self.tags[i] == "article"
            against[i] = bad or (p >= 0 and against[p])
            has[root[i]] |= self.tags[i] == "article"
        return inside & ~against, has[root]


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """Elements of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


@dataclass
class TreeModel:
    weight: np.ndarray
    #: [inline or block child][parent label][child label]
    edge: np.ndarray

    def marginals(self, tree: Tree, feature: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(content marginal of each element, marginals of each element's edge to its parent)."""
        parent, depth, inline = tree.arrays()
        n = len(parent)
        below = np.zeros((n, 2))
        below[:, 1] = np.bincount(element, self.weight[feature], n)  # own potential, then with messages from below
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        edge = self.edge[inline.astype(int)]
        by_depth = levels(depth)
        for level in by_depth[:0:-1]:
            up[level] = np.logaddexp.reduce(edge[level] + below[level][:, None, :], axis=2)
            np.add.at(below, parent[level], up[level])
        joint = np.zeros((n, 2, 2))
        for level in by_depth[1:]:
            above = below[parent[level]] + down[parent[level]] - up[level]
            down[level] = np.logaddexp.reduce(edge[level] + above[:, :, None], axis=1)
            both = edge[level] + above[:, :, None] + below[level][:, None, :]
            joint[level] = np.exp(both - np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None])
        belief = below + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -40, 40))), joint


def train(tree: Tree) -> TreeModel:
    """Gradient ascent on the likelihood of the labels of a forest, all of them known."""
    model = TreeModel(np.zeros(FEATURES), np.zeros((2, 2, 2)))
    if not tree.tags:
        return model
    feature, element = tree.features()
    parent, _, inline = tree.arrays()
    label = tree.marked()[0].astype(int)
    child = parent >= 0
    want = np.zeros((2, 2, 2))
    np.add.at(want, (inline[child].astype(int), label[parent[child]], label[child]), 1)
    gw, ge = np.full(FEATURES, 1e-6), np.full((2, 2, 2), 1e-6)
    for _ in range(STEPS):
        p, joint = model.marginals(tree, feature, element)
        grad = np.bincount(feature, (label - p)[element], FEATURES) / len(label) - SHRINK * model.weight
        gw += grad ** 2
        model.weight += RATE * grad / np.sqrt(gw)
        got = np.zeros((2, 2, 2))
        np.add.at(got, inline[child].astype(int), joint[child])
        grad = (want - got) / len(label) - SHRINK * model.edge
        ge += grad ** 2
        model.edge += RATE * grad / np.sqrt(ge)
    return model


def fit(pages: DataFrame, sample: int = SAMPLE) -> TreeModel:
    """Learn from at most ``sample`` pages with a marked article, chosen by a hash of the address, whole; they are taken
    to the driver, so the bound is one of pages, not of bytes.

    Each page teaches twice: as it is, and with blocks that speak against content grafted into its article. What speaks
    against content is a list of words (``AGAINST``) in the labels as in the features; names beside the list, links,
    sizes and places are learnt. Without a page to learn from all weights are zero and every marginal is one half."""
    marked = pages.select(F.xxhash64("url", "html").alias("h"), "html").where(F.lower("html").contains("<article"))
    share = 1.5 * sample / max(1, marked.count())
    rows = marked.where(F.pmod("h", F.lit(1 << 20)) / (1 << 20) < share).orderBy("h", "html").limit(sample).collect()
    tree = Tree()
    for row in rows:
        one = Tree()
        one.parse(row["html"])
        if one.marked()[1].all():
            tree.extend(one)
            one.graft(np.random.default_rng(crc32(row["html"].encode())))
            tree.extend(one)
    return train(tree)


def _extract(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lo in range(0, batch.num_rows, PAGES):
            tree, ends = Tree(), []
            for page in batch.column(2).slice(lo, PAGES):
                tree.parse(page.as_py() or "")
                ends.append(len(tree.pieces))
            content = model.value.marginals(tree, *tree.features())[0] > 0.5
            hidden = np.zeros(len(content), bool)
            for i, tag in enumerate(tree.tags):
                hidden[i] = tag in HIDDEN or (tree.parent[i] >= 0 and hidden[tree.parent[i]])
            shown = content & ~hidden
            for begin, end in zip([0, *ends], ends, strict=False):
                text = "".join(" " if t is None else t for e, t in tree.pieces[begin:end] if t is None or shown[e])
                out.append(BLANK.sub(" ", text).strip(" "))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """(page_id, url, text) of every page; text is empty if nothing is content, also for NULL or empty html.

    Pieces of text whose element has a content marginal over one half, in page order. One pass, no shuffle;
    repeated rows give repeated rows; other columns are not read."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    return pages.select("page_id", "url", "html").mapInArrow(partial(_extract, model=shared), "page_id bigint, url string, text string")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("page_id", F.col("page_id").cast("bigint"))
    return extract(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("bigint"))
