"""Exact n-gram Jaccard join over parity sketches.

A sketch has blocks of bits; every shingle flips one bit of one block, so the sketches of two sets differ in at most
as many bits as the sets differ in shingles. In a band of set sizes two sets that reach the similarity differ in at
most ``d`` shingles: of more than ``d`` blocks at least one is equal in both. Blocks are never materialised: a block's
fingerprint is the exclusive or of its shingles' hashes, in which, as in the bits, equal shingles cancel.

Which blocks are keys. Of ``m`` blocks at most d differ, so at least m - d agree, and the heaviest that agrees (by
shingles, then number) is among the d + 1 heaviest of either set. Blocks of fewer than ``LEAST`` shingles say little
and are left out: if that leaves a set with d keys or fewer, it also takes the keys of the next seed. Two linked sets
without a common key of one seed both are such sets, so they meet at a later one; at the last seed nothing is left out.

Sets with a common key become one candidate cluster by an edge to the least of them, so a block that many share costs one
edge a set.
Inside a cluster sets are cut by size into groups, compared with the groups of near sizes: first the Hamming distance
of sketches folded to few words, then the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import chunked, mix64, small_enough, stored, table, text_key
from helixframe.llm.components import components
from helixframe.llm.neardup import _distinct, shingles

#: Blocks for each key that is needed, least shingles of a key's block, and seeds.
SPARE, LEAST, SEEDS = 1.25, 2, 8
#: Keys of a task that are chained there before they are shuffled.
FLUSH = 1 << 20
#: Sets of a group of a cluster (a set of more than so many shingles counts as several), columns multiplied at once.
GROUP, HEAVY, COLUMNS = 1024, 1000, 4096


def bands(percent: int, largest: int) -> np.ndarray:
    """Least sizes of the bands: a set's partners are in its own band or the next ones beside it."""
    low = [1]
    while low[-1] <= largest or len(low) < 3:
        low.append(low[-1] * 100 // percent + 1)
    return np.array([*low, low[-1] * 100 // percent + 1])


def block_keys(shingle: np.ndarray, row: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the sketch blocks by which sets meet; ``shingle`` holds distinct hashes, by row."""
    size = np.bincount(row, minlength=rows)
    low = bands(percent, int(size.max(initial=1)))
    band = np.searchsorted(low, size, "right") - 1
    keys, of = [], []
    for joint in (band, band + 1):  # as the larger or an equal one, and as the smaller one of the next band
        high = low[joint + 1] - 1
        partner = np.minimum(high, size * 100 // percent)
        differ = (100 - percent) * (size + partner) // (100 + percent)
        blocks = np.ceil(SPARE * ((100 - percent) * 2 * high // (100 + percent) + 1)).astype(np.int64)
        active = (size > 0) & (differ > 0) & (partner >= low[joint])
        for seed in range(SEEDS):
            if not active.any():
                break
            least = LEAST if seed < SEEDS - 1 else 0
            mine = active[row]
            h, r = mix64(shingle[mine] ^ mix64(np.uint64([seed + 1]))), row[mine]
            block = ((h >> np.uint64(32)) * blocks[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            begin = np.cumsum(np.where(active, blocks, 0)) - np.where(active, blocks, 0)
            place = begin[r] + block
            order = np.argsort(place, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], place[order][1:] != place[order][:-1])))
            mark = np.bitwise_xor.reduceat(mix64(h[order] + np.uint64(0x5851F42D4C957F2D)), first)
            weight = np.diff(np.append(first, len(order)))
            r, block = r[order][first], block[order][first]
            if not least:  # empty blocks count too
                r, block, weight, mark = _with_empty(r, block, weight, mark, blocks, differ, active)
            order = np.lexsort((block, -weight, r))
            r, block, weight, mark = r[order], block[order], weight[order], mark[order]
            begin = np.searchsorted(r, np.arange(rows))
            take = (np.arange(len(r)) - begin[r] <= differ[r]) & (weight >= least)
            name = mix64(np.uint64(seed) + (joint[r].astype(np.uint64) << np.uint64(8)) + (block.astype(np.uint64) << np.uint64(24)))
            keys.append(mix64(mark ^ name ^ mix64(weight.astype(np.uint64)))[take])
            of.append(r[take])
            active = active & (np.bincount(r[take], minlength=rows) <= differ)
    return (np.concatenate(keys), np.concatenate(of)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _with_empty(r, block, weight, mark, blocks, differ, active):
    """The blocks given and, of a set that has too few, the first empty ones."""
    more_r, more_b = [], []
    for i in np.flatnonzero(active):
        own = block[r == i]
        free = np.setdiff1d(np.arange(min(int(blocks[i]), len(own) + int(differ[i]) + 1)), own)[:max(0, int(differ[i]) + 1 - len(own))]
        more_r += [i] * len(free)
        more_b += free.tolist()
    none = np.zeros(len(more_r), np.int64)
    return (np.concatenate((x, np.array(y, x.dtype))) for x, y in ((r, more_r), (block, more_b), (weight, none), (mark, none)))


def set_marks(shingle: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two sums of hashes of each set; together they stand for the set."""
    n, a, b = np.bincount(row, minlength=rows), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    if len(row):
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        a[row[start]] = np.add.reduceat(mix64(shingle), start)
        b[row[start]] = np.add.reduceat(mix64(shingle ^ np.uint64(0x2545F4914F6CDD1D)), start)
    return n, a, b


def _sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct shingle hashes, their rows) of chunks of a text column."""
    for lo, hi, data, at in chunked(column):
        key, row = shingles(data, at, size)
        first = _distinct(key, row)
        yield lo, hi - lo, key[first], row[first]


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [set_marks(key, row, rows) for _, rows, key, row in _sets_of(batch.column(2), size)]
        n, a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "key", "n", "fa", "fb"])


def _keys(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(v, a, b): a key and one of its sets (b NULL), or two sets of one key that met here."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        key, node = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        least = node[first][np.cumsum(first) - 1]
        met = np.flatnonzero(node != least)
        pair = np.unique(np.stack((node[met], least[met])), axis=1)
        none = pa.nulls(int(first.sum()), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((key[first], mix64(pair[0]))).view(np.int64)), pa.array(np.concatenate((node[first], pair[0])).view(np.int64)),
             pa.concat_arrays([none, pa.array(pair[1].view(np.int64))])], ["v", "a", "b"])

    for batch in batches:
        for _, rows, key, row in _sets_of(batch.column(0), size):
            v, of = block_keys(key, row, rows, percent)
            held.append((v, set_marks(key, row, rows)[1][of]))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield flush()
                held.clear()
    if sum(len(x[0]) for x in held):
        yield flush()


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set of a key with the least one, from rows sorted by key and set, and the pairs that came along."""
    last: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        one = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        v, a = (np.concatenate((x, batch.column(i).to_numpy()[one])) for i, x in enumerate(last))
        first = np.concatenate(([True] * min(1, len(v)), v[1:] != v[:-1]))
        least = a[first][np.cumsum(first) - 1]
        met = np.flatnonzero(a != least)
        pair = batch.filter(pa.array(~one))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a[met]), pair.column(1)]), pa.concat_arrays([pa.array(least[met]), pair.column(2)])], ["u", "v"])
        last = v[-1:], least[-1:]


def candidates(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): sets (by their first mark) that share a key; all sets of one key are connected."""
    keys = texts.mapInArrow(partial(_keys, size=size, percent=percent), "v bigint, a bigint, b bigint")
    return keys.repartition("v").sortWithinPartitions("v", "a").mapInArrow(_chains, "u bigint, v bigint").where("u <> v").distinct()


def folded(sets: list[np.ndarray], most: int) -> np.ndarray:
    """Parity sketches of words enough for distances up to ``most``: a row of 64-bit words for each set."""
    width = min(64, most // 16 + 1)
    out = np.zeros((len(sets), width), np.uint64)
    h = mix64(np.concatenate(sets))
    word = ((h >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(sets)), [len(x) for x in sets]), word), np.uint64(1) << (h & np.uint64(63)))
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles in common of every two sets."""
    size = [len(x) for x in sets]
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = (times > 1)[column]
    row, column = np.repeat(np.arange(len(sets)), size)[shared], number[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(number[-1]) + 1, COLUMNS):
        s, e = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(number[-1]) + 1 - lo)), np.float32)
        part[row[s:e], column[s:e] - lo] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def verified(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of the links: between all sets, or between side 0 and side 1 if both are there."""
    size = np.array([len(x) for x in sets])
    both = size[:, None] + size[None, :]
    bound = (100 - percent) * both // (100 + percent)
    near = np.abs(size[:, None] - size[None, :]) <= bound
    near &= (side[:, None] != side[None, :]) if side.any() and not side.all() else ~np.eye(len(sets), dtype=bool)
    sketch = folded(sets, int(bound.max()))
    for i in np.flatnonzero(near.any(axis=1)):
        j = np.flatnonzero(near[i])
        near[i, j] = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1) <= bound[i, j]
    some = np.flatnonzero(near.any(axis=1))
    if len(some):
        at = np.ix_(some, some)
        common = _common([sets[i] for i in some])
        near[at] &= 100 * common >= percent * (both[at] - common)
    return near


def _links(group: pa.Table, percent: int) -> pa.Table:
    """(u, v, links): of each set with links here, one that stands for its linked ones, and documents linked to it."""
    node, first = np.unique(group.column("node").to_numpy(), return_index=True)
    side, times = group.column("side").to_numpy()[first], group.column("times").to_numpy()[first]
    held = group.column("hashes").to_pylist()
    link = verified([np.frombuffer(held[i], np.uint64) for i in first], side, percent)
    label = np.arange(len(node))
    while True:  # the least label of a set's neighbours, until nothing changes
        new = np.minimum(label, np.where(link, label[None, :], len(node)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(link.any(axis=1))
    return pa.table({"u": pa.array(node[some]), "v": pa.array(node[label[some]]), "links": pa.array(link[some].astype(np.int64) @ times)})


def _hashes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, rows, key, row in _sets_of(batch.column(3), size):
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
            held = pa.array([key[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, rows) for i in range(3)), held], ["places", "node", "times", "hashes"])


def _places(members: DataFrame, percent: int) -> DataFrame:
    """(key, node, times, places): the pairs of groups in which each set of a cluster is compared.

    Groups hold sets of neighbouring sizes; a size that has more sets than a group takes is cut by hash. Only groups
    whose sizes allow a link are paired, so that clusters cost less than the square of their sets."""
    cost = F.count("*") * F.greatest(F.lit(1.0), F.col("n") / HEAVY)
    before = W.partitionBy("root").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    sizes = members.groupBy("root", "n").agg(cost.alias("cost"))
    sizes = sizes.select("root", "n", F.floor(F.coalesce(F.sum("cost").over(before), F.lit(0.0)) / GROUP).alias("slot"), F.ceil(F.col("cost") / GROUP).alias("cuts"))
    placed = stored(members.join(sizes, ["root", "n"]).withColumn("g", F.struct("slot", F.pmod(F.xxhash64("node"), F.col("cuts")).alias("cut"))))
    groups = placed.groupBy("root", "g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = groups.select("root", F.col("g").alias("o"), F.col("low").alias("olow"), F.col("high").alias("ohigh"))
    pairs = groups.join(other, "root").where((100 * F.col("high") >= percent * F.col("olow")) & (100 * F.col("ohigh") >= percent * F.col("low")))
    place = F.struct("root", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), F.when(F.col("g") > F.col("o"), 1).otherwise(0).alias("side"))
    pairs = pairs.groupBy("root", "g").agg(F.collect_list(place).alias("places"))
    return placed.join(pairs, ["root", "g"]).select("key", "node", "times", "places")


def linked_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, n_links) of each input row: distinct shingles, the least id reachable over
    links, and to how many other documents the row's document is linked itself.

    Documents are linked if 100 * shingles in common >= percent * shingles in either; ``percent`` is 1 to 100. NULL and
    empty texts, and texts of white space, have no shingles and no links: their component is their own id. A NULL id is
    the least only if its class has no other. Rows that share id and text are one document (``key`` names it) and get the
    same values. Columns beside doc_id and text are not read; an empty table gives an empty table. Keys are few where links
    ask for much in common: about a third of a key for each shingle at 85 percent, several at 50."""
    rows = docs.select(F.col("doc_id").cast("bigint"), text_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    signed = stored(rows.mapInArrow(partial(_sign, size=size), "doc_id bigint, key string, n bigint, fa bigint, fb bigint"))
    mark = ["fa", "fb", "n"]
    documents = signed.where("n > 0").groupBy(*mark, "key").agg(F.min("doc_id").alias("doc_id"))
    nodes = documents.groupBy(*mark).agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.count("*").alias("times"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    clusters = components(candidates(rows.select("text"), size, percent)).withColumnRenamed("node", "fa")
    members = nodes.select("fa", "n", "key", "times", "node").join(clusters, "fa")
    wanted = small_enough(stored(_places(members, percent)), items="places")

    kind = "places array<struct<root bigint, i struct<slot bigint, cut bigint>, j struct<slot bigint, cut bigint>, side int>>"
    sets = rows.join(wanted, "key").select("places", "node", "times", "text").mapInArrow(partial(_hashes, size=size), f"{kind}, node bigint, times bigint, hashes binary")
    each = sets.select(F.explode_outer("places").alias("p"), "node", "times", "hashes")
    each = each.select(F.struct("p.root", "p.i", "p.j").alias("p"), "p.side", "node", "times", "hashes")

    def of_group(group: pa.Table) -> pa.Table:
        return _links(group, percent)

    links = stored(each.groupBy("p").applyInArrow(of_group, "u bigint, v bigint, links bigint"))
    count = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.join(components(links.select("u", "v")), "node", "left").withColumn("class", F.coalesce("root", "node"))
    least = named.groupBy("class").agg(F.min("first_id").alias("component_id"))
    found = named.join(least, "class").join(count, "node", "left").select(*mark, "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    has = F.col("n") > 0
    return signed.join(found, mark, "left").select(
        "doc_id", "key", F.col("n").alias("n_shingles"), F.when(has, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(has, F.col("n_links")).otherwise(0).alias("n_links"))


def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(table(spark, sf_dir, "documents"), 4, 85).drop("key")


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
k AS (SELECT u, count(*) AS k FROM e GROUP BY 1),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON r.root = e.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, coalesce(k.k, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.u = d.doc_id
JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) c ON c.node = d.doc_id
"""
