"""Near duplicates with an LSH forest of MinHash signatures.

Documents with equal shingle sets fold into one node first. Every tree sorts the nodes by its own sequence of
MinHash values; a range sort spreads even one dense region over many tasks. Neighbours in that order that share a
long enough prefix are candidates: ``depth`` values everywhere, one less where few nodes share that shorter
prefix. As neighbours form chains, all nodes of a region fall into one candidate cluster with as many candidates
as nodes. Inside a cluster - in blocks, if it is large - similarities are counted exactly on the full sets, and
only a spanning forest of the links leaves the task.

A pair of similarity s stays apart in all trees with probability (1 - s**depth)**trees: at s = 0.85 and the
parameters of op10 below 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import chunked, mix64, powers, rolling, small_enough, stored, table, text_key, words
from helixframe.llm.components import components

TREES = 24
#: Most nodes of a region that are neighbours with one value less.
SPARSE = 16
#: Nodes, and shingles, of a block of a cluster.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 2_000_000
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 4096


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the word shingles of a chunk, by row, with repeats; a shorter text is one shingle."""
    _, _, row, h = words(data, at)
    key, first = rolling(h, row, size)
    keys, rows = [key], [row[first]]
    n = np.bincount(row, minlength=len(at) - 1)
    begin = np.cumsum(n) - n
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        total = np.full(len(short), k, np.uint64)
        for j, p in enumerate(powers(k + 1)[1:]):
            total += h[begin[short] + j] * p
        keys.append(mix64(total))
        rows.append(short)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return key[order], row[order]


def _distinct(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which shingles are the first of their kind in their text."""
    own = key ^ mix64(row.astype(np.uint64))
    order = np.argsort(own, kind="stable")
    first = np.ones(len(key), bool)
    first[order[1:]] = own[order[1:]] != own[order[:-1]]
    return first


def _signatures(batches: Iterator[pa.RecordBatch], size: int, values: int) -> Iterator[pa.RecordBatch]:
    a = mix64(np.arange(1, values + 1, dtype=np.uint64)) | np.uint64(1)
    b = mix64(np.arange(1, values + 1, dtype=np.uint64) + np.uint64(1 << 32))
    for batch in batches:
        n = batch.num_rows
        count, fa, fb = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        sig = np.zeros((n, values), np.uint32)
        for lo, _, data, at in chunked(batch.column(2)):
            key, row = shingles(data, at, size)
            if not len(key):
                continue
            start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            to = lo + row[start]
            first = _distinct(key, row)
            count[to] = np.add.reduceat(first.astype(np.int64), start)
            fa[to] = np.add.reduceat(np.where(first, mix64(key), np.uint64(0)), start)
            fb[to] = np.add.reduceat(np.where(first, mix64(key ^ b[0]), np.uint64(0)), start)
            for k in range(values):
                sig[to, k] = np.minimum.reduceat((key ^ b[k]) * a[k], start) >> np.uint64(32)
        held = pa.array([s.tobytes() if c else None for s, c in zip(sig, count, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), held], ["doc_id", "key", "n", "fa", "fb", "sig"])


def _labels(batches: Iterator[pa.RecordBatch], trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    """A row for each tree and node: the tree's first ``depth`` values, as one number each for all but the last."""
    for batch in batches:
        node = batch.column(0).to_numpy()
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(node), -1) if len(node) else np.zeros((0, trees * depth), np.uint32)
        for t in range(trees):
            label = np.full(len(node), t, np.uint64)
            for k in range(depth - 1):
                label = mix64(label ^ mix64(sig[:, t * depth + k].astype(np.uint64) + np.uint64(1)))
            last = sig[:, t * depth + depth - 1].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(label.view(np.int64)), pa.array(last), pa.array(node)], ["region", "last", "node"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among the sorted rows of a task; its first and last rows leave with u = NULL to be joined up."""
    names = ["u", "v", "region", "last", "edge"]
    tail: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        region, last, node = (batch.column(i).to_numpy() for i in range(3))
        if tail is None:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(node[:1]), pa.array(region[:1]), pa.array(last[:1]), pa.array(["first"])], names)
        else:
            region, last, node = (np.concatenate(([x], y)) for x, y in zip(tail, (region, last, node), strict=True))
        same = region[1:] == region[:-1]
        ends = np.flatnonzero(np.concatenate((~same, [True])))
        size = np.diff(np.concatenate(([-1], ends)))
        sparse = np.repeat(size <= SPARSE, size)[1:]
        pick = np.flatnonzero(same & (sparse | (last[1:] == last[:-1])))
        if len(pick):
            yield pa.RecordBatch.from_arrays([pa.array(node[pick + 1]), pa.array(node[pick]), pa.array(region[pick]), pa.array(last[pick]), pa.array(["in"] * len(pick))], names)
        tail = (region[-1], last[-1], node[-1])
    if tail is not None:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([int(x)]) for x in (tail[2], tail[0], tail[1])), pa.array(["last"])], names)


def candidates(nodes: DataFrame, trees: int, depth: int) -> DataFrame:
    """(u, v): neighbours in some tree of ``nodes`` (node, sig)."""
    rows = stored(nodes.mapInArrow(partial(_labels, trees=trees, depth=depth), "region bigint, last bigint, node bigint"))
    ordered = rows.repartitionByRange("region", "last", "node").sortWithinPartitions("region", "last", "node")
    found = stored(ordered.mapInArrow(_neighbours, "u bigint, v bigint, region bigint, last bigint, edge string"))
    # Two rows for each task: the last one before a task's first row is its neighbour.
    ends = found.where("u IS NULL").select("region", "last", "v", "edge")
    order = W.orderBy("region", "last", "v", F.col("edge") == "last")
    before = lambda c: F.lag(c).over(order)
    joints = ends.withColumns({"pr": before("region"), "pl": before("last"), "u": before("v")}).where("edge = 'first' AND pr = region AND pl = last AND u <> v")
    return found.where("u IS NOT NULL").select("u", "v").unionByName(joints.select("u", "v")).distinct()


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, at in chunked(batch.column(2)):
            key, row = shingles(data, at, size)
            first = _distinct(key, row)
            key, row = key[first], row[first]
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=hi - lo))))
            held = pa.array([key[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), held], ["place", "node", "hashes"])


def _links(group: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the links among the nodes of a block (or two): (u, v)."""
    node = group.column("node").to_numpy()
    order = np.argsort(node)
    node = node[order]
    held = group.column("hashes").to_pylist()
    sets = [np.frombuffer(held[i], np.uint64) for i in order]
    size = np.array([len(x) for x in sets])
    every, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1  # columns of shingles that two nodes at least hold
    row = np.repeat(np.arange(len(sets)), size)
    shared = (times > 1)[column]
    row, column = row[shared], number[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(number[-1]) + 1, COLUMNS):
        s, e = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[s:e], column[s:e] - lo] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    label = np.arange(len(sets))
    while True:  # the least label of a node's neighbours, until nothing changes
        new = np.where(linked, label[None, :], len(sets)).min(axis=1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(sets)))
    return pa.table({"u": pa.array(node[tied]), "v": pa.array(node[label[tied]])})


def near_classes(docs: DataFrame, size: int, percent: int, trees: int = TREES, depth: int = 4) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, class) for each input row: the least id reachable over links, and a number
    of its class (NULL without shingles).

    Documents are linked if 100 * shingles in common >= percent * shingles in either. NULL and empty texts have no
    shingles and no links: their component is their own id. A NULL id is the least only if its class has no other.
    Rows that share id and text are one document. Extra columns are not read."""
    rows = docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    signed = stored(rows.mapInArrow(partial(_signatures, size=size, values=trees * depth), "doc_id bigint, key string, n bigint, fa bigint, fb bigint, sig binary"))
    full = signed.where("n > 0")
    nodes = full.groupBy("fa", "fb", "n").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    own = full.select("fa", "fb", "n", "key", "sig").join(nodes, ["fa", "fb", "n", "key"]).groupBy("node").agg(F.first("sig").alias("sig"))
    clusters = components(candidates(own, trees, depth))
    clusters = stored(clusters.join(nodes.select("node", "n", "key"), "node"))
    blocks = clusters.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    placed = clusters.join(blocks, "root").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")))
    places = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.col("root").alias("root"), F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    wanted = small_enough(stored(placed.select("key", "node", places.alias("place")).distinct()), items="place")

    sets = rows.join(wanted, "key").select("place", "node", "text").mapInArrow(partial(_sets, size=size), "place array<struct<root bigint, i bigint, j bigint>>, node bigint, hashes binary")
    each = sets.select(F.explode_outer("place").alias("p"), "node", "hashes")

    def linked(group: pa.Table) -> pa.Table:
        return _links(group, percent)

    links = stored(each.groupBy("p").applyInArrow(linked, "u bigint, v bigint"))
    roots = stored(components(links))
    named = roots.join(nodes.select("node", "first_id"), "node")
    best = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    moved = named.join(best, "root").select("node", "component_id", "root")
    classes = nodes.join(moved, "node", "left").select("fa", "fb", "n", F.coalesce("root", "node").alias("class"), F.coalesce("component_id", "first_id").alias("component_id"))
    return signed.join(classes, ["fa", "fb", "n"], "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "class")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each class (five words, 0.8) stays: of the least id (none last), then the least key, then
    one of equal rows. Of texts without words only repeated rows (same id and text) become one."""
    rows = stored(docs.select(F.struct("*").alias("row"), text_key(F.col("doc_id"), F.col("text")).alias("key"), F.monotonically_increasing_id().alias("number")))
    classes = near_classes(rows.select("row.doc_id", "row.text"), 5, 80, depth=3).groupBy("key").agg(F.min("class").alias("class"))
    each = rows.select("key", "number", "row.doc_id").join(classes, "key")
    each = stored(each.select(F.coalesce(F.col("class").cast("string"), "key").alias("class"), F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "number").alias("place")))
    best = each.groupBy("class").agg(F.min("place").alias("best"))
    lost = each.join(best, "class").where("place.number <> best.number").select("place.number")
    return rows.join(small_enough(stored(lost)), "number", "left_anti").select("row.*")


def is_kept() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"), 3, 85)
    return out.select("doc_id", "n_shingles", "component_id", is_kept())


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON r.root = e.u )
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) c ON c.node = d.doc_id
"""
