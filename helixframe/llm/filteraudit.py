"""What filters do to a corpus in every order they can be applied.

A document fails some set of the filters: its mask. Documents are counted by mask, part and weights, which is all that
the orders depend on. With a mask matrix (0 where a mask fails a filter, infinity elsewhere) and the inverse
permutations (step at which an order applies a filter), the min-plus product - the minimum over filters of their sum -
is the step at which an order removes a mask's documents. Counts are scattered by that step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import BYTE_VALUE, CONTINUES, chunked, powers, runs, span_hashes, mix64, stored, table

#: The per-text filters in order of their letters; the last letter is the copies of an earlier text.
FILTERS = "ABCDE"
MARKS = b"#$%&*|"
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
UPPER, MARK = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
MARK[list(MARKS)] = True
WEIGHTS = ["n", "good", "toxic"]


def failing(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bits of the failed per-text filters (A is the lowest) of each text of a chunk."""
    rows = len(at) - 1
    start, end, row = runs(~SPACE[data], at)
    words = np.bincount(row, minlength=rows)
    own = span_hashes(data, start, end, BYTE_VALUE) ^ mix64(row.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    first = np.ones(len(own), bool)
    first[order[1:]] = own[order[1:]] != own[order[:-1]]
    distinct = np.bincount(row[first], minlength=rows)

    def count(inside: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(inside)))
        return total[at[1:]] - total[at[:-1]]

    points = count(~CONTINUES[data])
    bad = [words < 200, 100 * distinct < 50 * words, 100 * count(UPPER[data]) > 3 * points, count(MARK[data]) > 0]
    return sum(b.astype(np.int64) << k for k, b in enumerate(bad))


def text_marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each whole text, by which equal texts are found."""
    return span_hashes(data, at[:-1], at[1:], BYTE_VALUE), span_hashes(data, at[:-1], at[1:], mix64(BYTE_VALUE ^ powers(2)[1]))


def _masks(batches: Iterator[pa.RecordBatch], masks: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        mask, a, b = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
        for lo, hi, data, at in chunked(batch.column(2)):
            mask[lo:hi] = masks(data, at)
            a[lo:hi], b[lo:hi] = text_marks(data, at)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "part", "mask", "a", "b"])


def mask_counts(docs: DataFrame, labels: DataFrame, part: Column, masks=failing, copies: int = FILTERS.index("E")) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each set of failed filters, and those among them that are labelled so.

    ``masks`` gives the bits of the per-text filters of a chunk; bit ``copies`` is for texts that a smaller id has too,
    in the whole table. A NULL text is empty; a NULL id has no smaller one and is smaller than none; rows that share an
    id are not copies of each other. If labels repeat an id, a document counts once with the larger marks."""
    read = docs.select(F.col("doc_id").cast("bigint"), part.alias("part"), "text")
    rows = stored(read.mapInArrow(lambda it: _masks(it, masks), "doc_id bigint, part string, mask int, a bigint, b bigint"))
    # The first of equal texts is known by text and id together, so a text with very many copies is no hot key.
    first = rows.where("doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    bit = F.when(F.col("first") | F.col("doc_id").isNull(), 0).otherwise(1 << copies)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    each = rows.join(first, ["a", "b", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce(bit, F.lit(1 << copies))).alias("mask")).join(marks, "doc_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return each.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def removal_steps(masks: np.ndarray, filters: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, step): all orders of the filters, and for each order and mask the step that removes it (from 0; the
    number of filters: none)."""
    orders = np.array(list(permutations(range(filters))))
    position = np.argsort(orders, axis=1).astype(float)  # inverse permutations: the step of each filter
    cost = np.where(masks[:, None] >> np.arange(filters) & 1, 0.0, np.inf)
    step = np.minimum(np.min(position[:, None, :] + cost[None, :, :], axis=2), filters)
    return orders, step.astype(np.int64)


def _effects(group: pa.Table, letters: str) -> pa.Table:
    filters = len(letters)
    mask = group.column("mask").to_numpy()
    weight = {c: group.column(c).to_numpy() for c in WEIGHTS}
    orders, step = removal_steps(mask, filters)
    m = len(orders)

    def scatter(w: np.ndarray) -> np.ndarray:
        """Sums of ``w`` by order and step of removal."""
        out = np.zeros((m, filters + 1), np.int64)
        np.add.at(out, (np.arange(m)[:, None], step), np.broadcast_to(w, step.shape))
        return out

    n = weight["n"]
    removed, good, toxic = (scatter(weight[c])[:, :filters] for c in WEIGHTS)
    kept = n.sum() - np.cumsum(removed, axis=1)
    fails = (mask[:, None] >> np.arange(filters) & 1).astype(bool)
    # All that fail an order's k-th filter are removed by it or before it.
    redundant = (fails * n[:, None]).sum(axis=0)[orders] - removed
    alone = np.array([n[mask == 1 << f].sum() for f in range(filters)], np.int64)[orders]
    shapley = np.zeros(filters, np.int64)
    np.add.at(shapley, orders, removed)
    name = ["".join(letters[f] for f in o) for o in orders]
    flat = lambda x: pa.array(np.ascontiguousarray(x, np.int64).ravel())
    return pa.table({
        "part": pa.array([group.column("part")[0].as_py()] * (m * filters), pa.string()), "filter_order": pa.array(np.repeat(name, filters).tolist(), pa.string()),
        "step": pa.array(np.tile(np.arange(1, filters + 1), m).astype(np.int32)), "kept": flat(kept), "removed": flat(removed), "redundant": flat(redundant),
        "unique_fails": flat(alone), "good_lost": flat(good), "toxic_lost": flat(toxic), "shapley": flat(shapley[orders])})


def audit(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """A row for each part, order of all filters and step, from ``mask_counts``: kept after the step, removed by it,
    failing its filter but removed before, failing it alone, labelled ones lost, and ``shapley``: what its filter
    removes, summed over all orders. Every order has a row for every step, zeros included; no documents, no rows."""

    def of_part(group: pa.Table) -> pa.Table:
        return _effects(group, letters)

    longs = ", ".join(f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return counts.groupBy("part").applyInArrow(of_part, f"part string, filter_order string, step int, {longs}")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.coalesce("lang", F.lit(""))))


OP13_SQL = r"""
WITH f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a JOIN f b ON a.f <> b.f JOIN f c ON c.f NOT IN (a.f, b.f)
  JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
m AS (
  SELECT part, concat(
      CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN w.doc_id > first THEN 'E' END) AS m,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON w.doc_id = l.doc_id),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY ALL),
s AS (
  SELECT c.*, o, k.k AS step, o[k.k] AS f, contains(m, o[k.k]) AS fails,
    len(list_filter(string_split(m, ''), lambda x: x <> '' AND contains(left(o, k.k - 1), x))) > 0 AS before
  FROM c CROSS JOIN o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) k),
r AS (
  SELECT part, o AS filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT before), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE fails AND NOT before), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE fails AND before), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE m = f), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE fails AND NOT before), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE fails AND NOT before), 0)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""
