"""How far the sources of a language lie apart, over the terms they use, in whole numbers.

The matrix of groups (rows) and terms (columns) is mostly zero. It is cut into squares of at most ``SIDE`` groups by
about ``COLUMNS`` terms; a square is a K-squared tree: a quadrant without a count has no node, the others have
K * K children down to single cells. Two squares on the same columns are traversed together, quadrant by quadrant:

* both zero - nothing is visited: all their cells are worth the same for a pair of groups, and are priced by number;
* one zero - its side is the same everywhere, so cells of the other with equal values are priced once, by number;
* both not - their children are visited, at last the two cells.

No pair of groups is formed for a term before its square is at hand, and no square holds more than a set size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import FOLD, FOLDED_VALUE, chunked, runs, span_hashes, stored, table

#: Children of a node by side, levels of a tree: K ** LEVELS rows and columns at most.
K, LEVELS = 4, 4
SIDE = K ** LEVELS
#: Terms of a square on average (hashed, so that a square of more than SIDE is beyond all chance; such a one gets another level).
COLUMNS = 160
UNIT = 1_000_000_000
#: Pairs of nodes visited, and priced cells, at once.
VISITED, PRICED = 4096, 4096

_letter = np.zeros(256, bool)
_letter[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each batch: occurrences, and texts that hold the term."""
    for batch in batches:
        lang, source = (pc.fill_null(batch.column(i), "").dictionary_encode() for i in (0, 1))
        group = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        for lo, hi, data, at in chunked(batch.column(2), 4 << 20):
            start, end, row = runs(_letter[data], at)
            if not len(start):
                continue
            h = span_hashes(data, start, end, FOLDED_VALUE)
            _, first, term = np.unique(h, return_index=True, return_inverse=True)
            cell = group[lo:hi][row] * len(first) + term
            known, place, n = np.unique(cell, return_inverse=True, return_counts=True)
            once = np.unique(row * len(known) + place)
            docs = np.bincount(once % len(known), minlength=len(known))
            # The terms' bytes, folded, one after the other.
            size = (end - start)[first]
            ends = np.cumsum(size)
            byte = FOLD[data[np.repeat(start[first] - ends + size, size) + np.arange(ends[-1])]].astype(np.uint8)
            names = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(byte)])
            g = known // len(first)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(g % max(1, len(source.dictionary)))),
                 names.take(pa.array(known % len(first))).cast(pa.string()), pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n): occurrences of each term that ``least_docs`` documents of its language hold."""
    each = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    cells = stored(each.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term")
    return cells.join(kept, ["lang", "term"]).select("lang", "source", "term", "n")


def price(count: Column, total: Column, terms: Column) -> Column:
    """Smoothed share in billionths, at least 1; exact for any counts (DECIMAL arithmetic)."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = (total + 2 * terms).cast("decimal(20,0)")
    return 1 + ((above - above % below) / below).cast("bigint")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of whole numbers up to a billion and one."""
    d = p - q
    return d * d // (p + q)


class Square:
    """A tree over the cells (row, column, value) of one square, with the nodes of every level in order of place."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, levels: int):
        place = np.zeros(len(row), np.int64)
        for level in range(levels):  # digits of row and column in turn, the most significant first
            unit = K ** (levels - 1 - level)
            place = place * K * K + row // unit % K * K + column // unit % K
        order = np.argsort(place)
        self.row, self.column, self.value, self.levels = row[order], column[order], value[order], levels
        self.place = [place[order]]
        for _ in range(levels):
            self.place.insert(0, np.unique(self.place[0] // (K * K)))

    def children(self, level: int, node: np.ndarray) -> np.ndarray:
        """Of each node of a level, its K by K children by row and column digit, or -1."""
        below = self.place[level + 1]
        want = self.place[level][node][:, None] * (K * K) + np.arange(K * K)
        at = np.minimum(np.searchsorted(below, want), len(below) - 1)
        return np.where(below[at] == want, at, -1).reshape(-1, K, K)

    def at(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of quadrants of a level."""
        place = self.place[level][node]
        row, column = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for k in range(level):
            digit = place // (K * K) ** k % (K * K)
            row += digit // K * K ** k
            column += digit % K * K ** k
        return row, column

    def cells(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``node``, cell) of all cells below nodes of a level."""
        unit = (K * K) ** (self.levels - level)
        lo = np.searchsorted(self.place[-1], self.place[level][node] * unit)
        hi = np.searchsorted(self.place[-1], (self.place[level][node] + 1) * unit)
        n = hi - lo
        of = np.repeat(np.arange(len(node)), n)
        return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[of]


class Sums:
    """What two squares come to: ``worth`` by rows, and the columns in which neither row has a count, by quadrants."""

    def __init__(self, zero_a: np.ndarray, zero_b: np.ndarray, levels: int):
        self.zero = zero_a, zero_b
        self.worth = np.zeros((len(zero_a), len(zero_b)), np.int64)
        self.taken = np.zeros_like(self.worth)
        self.none = [np.zeros((K ** n, K ** n), np.int64) for n in range(levels + 1)]

    def both_zero(self, level: int, a: np.ndarray, b: np.ndarray, width: np.ndarray) -> None:
        np.add.at(self.none[level], (a, b), width)

    def one_zero(self, tree: Square, level: int, node: np.ndarray, other: np.ndarray, width: np.ndarray, swap: bool) -> None:
        """The cells below ``node`` against the rows of quadrants ``other`` without a count, and their columns."""
        mine, _ = tree.at(level, node)
        self.both_zero(level, *((other, mine) if swap else (mine, other)), width)
        of, cell = tree.cells(level, node)
        side, zero, high = K ** (tree.levels - level), self.zero[not swap], K ** tree.levels
        # Cells of one row with one value against the same rows are one price, times their number (values are below 2^31).
        known, times = np.unique((tree.row[cell] * high + other[of] * side) << 31 | tree.value[cell], return_counts=True)
        for k in range(0, len(known), PRICED):
            place, value, number = known[k:k + PRICED] >> 31, known[k:k + PRICED] & 0x7FFFFFFF, times[k:k + PRICED]
            i = np.repeat(place // high, side)
            j = ((place % high)[:, None] + np.arange(side)).ravel()
            inside = j < len(zero)
            i, j, value, number = i[inside], j[inside], np.repeat(value, side)[inside], np.repeat(number, side)[inside]
            at = (j, i) if swap else (i, j)
            np.add.at(self.worth, at, gap(value, zero[j]) * number)
            np.add.at(self.taken, at, number)

    def total(self) -> np.ndarray:
        rows, columns = self.worth.shape
        none = -self.taken
        for n, quadrants in enumerate(self.none):
            side = K ** (len(self.none) - 1 - n)
            none += np.repeat(np.repeat(quadrants[:-(-rows // side), :-(-columns // side)], side, axis=0), side, axis=1)[:rows, :columns]
        return self.worth + none * gap(self.zero[0][:, None], self.zero[1][None, :])


def joint(a: Square, b: Square, zero_a: np.ndarray, zero_b: np.ndarray, columns: int) -> np.ndarray:
    """Matrix of sums over the columns of two squares of ``gap`` of each row of a and each row of b.

    ``zero_a`` and ``zero_b``: the value of a cell without a count in each row."""
    levels = a.levels
    sums = Sums(zero_a, zero_b, levels)

    def visit(level: int, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of nodes on the same columns: x of a and y of b, both with counts."""
        if len(x) > VISITED:
            visit(level, x[:VISITED], y[:VISITED])
            return visit(level, x[VISITED:], y[VISITED:])
        unit = K ** (levels - level - 1)
        (rx, column), (ry, _) = a.at(level, x), b.at(level, y)
        shape = (len(x), K, K, K)  # row of a, row of b, column
        u = np.broadcast_to(a.children(level, x)[:, :, None, :], shape)
        v = np.broadcast_to(b.children(level, y)[:, None, :, :], shape)
        digit = np.arange(K)
        ra = np.broadcast_to((rx * K)[:, None, None, None] + digit[:, None, None], shape)
        rb = np.broadcast_to((ry * K)[:, None, None, None] + digit[:, None], shape)
        width = np.broadcast_to(np.clip(columns - ((column * K)[:, None, None, None] + digit) * unit, 0, unit), shape)
        zero = (u < 0) & (v < 0)
        sums.both_zero(level + 1, ra[zero], rb[zero], width[zero])
        left, right, both = (u >= 0) & (v < 0), (u < 0) & (v >= 0), (u >= 0) & (v >= 0)
        sums.one_zero(a, level + 1, u[left], rb[left], width[left], False)
        sums.one_zero(b, level + 1, v[right], ra[right], width[right], True)
        if level + 1 < levels:
            visit(level + 1, u[both], v[both])
        else:
            np.add.at(sums.worth, (a.row[u[both]], b.row[v[both]]), gap(a.value[u[both]], b.value[v[both]]))

    root = np.zeros(1, np.int64)
    if len(a.row) and len(b.row):
        visit(0, root, root)
    elif len(a.row):
        sums.one_zero(a, 0, root, root, np.array([columns]), False)
    elif len(b.row):
        sums.one_zero(b, 0, root, root, np.array([columns]), True)
    else:
        sums.both_zero(0, root, root, np.array([columns]))
    return sums.total()


def _square(group: pa.Table) -> pa.Table:
    """(lang, i, j, more): by pair of groups, the sum over this square's terms less that of all of them without a count.

    Rows with a term are cells; those without name a group (``r`` its number, ``p`` its value without a count)."""
    lang = group.column("s").combine_chunks().field("lang")[0].as_py()
    term, block, r, p = (group.column(c) for c in ("term", "block", "r", "p"))
    r, p, block = r.to_numpy(), p.to_numpy(), block.to_numpy()
    term = term.combine_chunks()
    own = term.is_null().to_numpy(zero_copy_only=False)
    names = term.dictionary_encode()
    column = pc.fill_null(names.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    columns = len(names.dictionary)
    # Terms that many groups hold come first: what is zero lies together.
    rank = np.empty(columns, np.int64)
    rank[np.argsort(-np.bincount(column[~own], minlength=columns), kind="stable")] = np.arange(columns)
    blocks = np.unique(block)
    levels = LEVELS
    while K ** levels < columns:
        levels += 1
    zeros, base, trees = [], [], []
    for b in blocks:
        mine = own & (block == b)
        by = np.argsort(r[mine])
        zeros.append(p[mine][by])
        base.append(int(r[mine].min()))
        cell = ~own & (block == b)
        trees.append(Square(r[cell] - base[-1], rank[column[cell]], p[cell], levels))
    last = len(blocks) - 1
    got = joint(trees[0], trees[last], zeros[0], zeros[last], columns) - columns * gap(zeros[0][:, None], zeros[last][None, :])
    i, j = (x.ravel() for x in np.indices(got.shape))
    i, j, got = i + base[0], j + base[last], got.ravel()
    pick = i < j
    return pa.table({"lang": pa.array([lang] * int(pick.sum()), pa.string()), "i": pa.array(i[pick]), "j": pa.array(j[pick]), "more": pa.array(got[pick])})


def _pairs(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language."""
    zero = groups.where("terms > 0").select("lang", "r", F.col("p0").alias("p"), F.floor(F.col("r") / SIDE).alias("block"), "terms")
    strips = F.ceil(F.col("terms") / COLUMNS)
    rows = cells.select("lang", "r", "p", "term", F.floor(F.col("r") / SIDE).alias("block"), F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / COLUMNS)).alias("strip"))
    heads = zero.select("lang", "r", "p", F.lit(None).cast("string").alias("term"), "block", F.explode(F.sequence(F.lit(0).cast("bigint"), strips - 1)).alias("strip"))
    blocks = zero.groupBy("lang").agg(F.max("block").alias("last"))
    every = rows.unionByName(heads).join(blocks, "lang")
    partner = F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("o")
    every = every.select("lang", "r", "p", "term", "block", "strip", partner)
    s = F.struct("lang", "strip", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y")).alias("s")
    more = every.select(s, "term", "block", "r", "p").groupBy("s").applyInArrow(_square, "lang string, i bigint, j bigint, more bigint")
    more = more.groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))
    more = more.unionByName(more.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "more"))
    one = groups.select("lang", "source", F.col("r").alias("i"), F.col("p0").alias("p"), "terms")
    two = groups.select("lang", F.col("source").alias("item"), F.col("r").alias("j"), F.col("p0").alias("q"))
    both = one.join(two, "lang").where("i <> j").join(more, ["lang", "i", "j"], "left")
    empty = F.when(F.col("terms") > 0, F.col("terms") * F.expr("(p - q) * (p - q) div (p + q)")).otherwise(0)
    return both.select("lang", "source", "item", (empty + F.coalesce("more", F.lit(0))).alias("value"))


def divergences(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): sources of a language against each other, and terms that mark a source.

    Part ``pair``: every other source of the language, ``value`` the sum over the language's kept terms (those in
    ``least_docs`` documents of it or more). Part ``term``: at most ``top`` terms that the source holds with a larger
    share than its language does. NULL text, lang and source are ''. Each row of the table is a document, repeated
    rows and NULL ids included. Groups without terms, and languages without kept terms, are there (value 0 without
    kept terms); one source alone has no pairs. Ties go by the item's UTF-8. Other columns are not read.

    Tables that one task orders: the sources of one language by size, and those of one source's pairs."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = stored(term_counts(docs, least_docs))
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "total_lang"])
    order = W.partitionBy("lang").orderBy(F.desc("total"), "source")
    p0 = F.when(F.col("terms") > 0, price(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
    groups = stored(groups.select("*", (F.row_number().over(order) - 1).cast("bigint").alias("r"), p0.alias("p0")))
    cells = counts.join(groups, ["lang", "source"]).withColumn("p", price(F.col("n"), F.col("total"), F.col("terms")))
    cells = stored(cells.select("lang", "source", "term", "r", "p", "terms", "total_lang"))

    marks = cells.join(of_lang, ["lang", "term"]).withColumn("q", price(F.col("n_lang"), F.col("total_lang"), F.col("terms")))
    marks = marks.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    pairs = _pairs(groups, cells).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return rank(pairs).unionByName(rank(marks).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
m AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (m.n + 2 * l.v) AS p
  FROM m JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT k.lang, k.term, 1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q FROM k JOIN l USING (lang)),
x AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""
