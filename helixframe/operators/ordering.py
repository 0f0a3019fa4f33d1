"""Exact ordinals and running totals that do not put a whole group in one task.

``dense_index``   orders by an integer ordinal.  A group is cut into chunks of the
                  ordinal's range, so a task holds at most ``chunk`` rows of a
                  group; chunk totals (tiny) give the offsets.
``running_totals`` orders by anything.  The rows are range-partitioned on
                  (keys, order), the placement is fixed by a checkpoint, and a scan
                  of each partition carries the sums; a row per partition gives the
                  offsets.  A group that holds a third of all rows is spread over a
                  third of the partitions, and the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from helixframe.functions.checkpoints import cut_lineage

CHUNK = 65536


def dense_index(
    df: DataFrame, keys: Sequence[str], ordinal: str, out: str, chunk: int = CHUNK
) -> DataFrame:
    """Add ``out``: 0-based rank of the unique, non-negative integer ``ordinal``
    within ``keys``."""
    keys = list(keys)
    cut = df.withColumn("_chunk", F.floor(F.col(ordinal) / F.lit(chunk)))
    in_chunk = Window.partitionBy(*keys, "_chunk")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = cut.withColumn("_local", F.row_number().over(in_chunk.orderBy(ordinal)) - 1)
    return (
        local.join(sizes, [*keys, "_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("int"))
        .drop("_chunk", "_local", "_before")
    )


def _numbers(column: pa.Array) -> np.ndarray:
    """Values with NULL as 0."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)


class _Carry:
    """What a scan knows at the end of a batch: the group it is in and the sums up to there."""

    def __init__(self, sums: int, totals: int):
        self.key: int | None = None
        self.first: int | None = None
        self.head = True
        self.sums: list = [0] * (sums + 1)
        self.totals: list = [None] * totals

    def read(self, key: np.ndarray, row: np.ndarray, values: list[np.ndarray], totals: list[pa.Array]):
        """(in the partition's first group, running sums, totals of the group) of each row of the next batch."""
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        on = self.key is not None and key[0] == self.key
        if self.first is None:
            self.first = int(key[0])
        head = (group == 0) & ((self.key is None or on) and self.head)
        self.head = bool(head[-1])
        running = []
        for i, x in enumerate([row, *values]):
            total = np.cumsum(x)
            total = total - np.repeat(total[start] - x[start], np.diff(np.append(start, len(key))))
            if on:
                total = total + np.where(group == 0, self.sums[i], 0)
            self.sums[i] = total[-1].item()
            running.append(total)
        known = []
        for i, column in enumerate(totals):  # a group's total stands in its first row
            at = pc.take(column, pa.array(start))
            if on and not at[0].is_valid:
                at = pa.concat_arrays([pa.array([self.totals[i]], at.type), at[1:]])
            self.totals[i] = at[-1].as_py()
            known.append(pc.take(at, pa.array(group)))
        self.key = int(key[-1])
        return head, running, known


def _scan(batches: Iterator[pa.RecordBatch], values: list[str], totals: list[str]) -> Iterator[pa.RecordBatch]:
    carry = _Carry(len(values), len(totals))
    for batch in batches:
        if not batch.num_rows:
            continue
        head, running, known = carry.read(batch["_k"].to_numpy(), batch["_row"].to_numpy(), [_numbers(batch[v]) for v in values], [batch[t] for t in totals])
        more = [pa.array(head), *(pa.array(x) for x in running), *known]
        names = ["_head", "_r", *(f"_s_{i}" for i in range(len(values))), *(f"_t_{i}" for i in range(len(totals)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])


def _ends(batches: Iterator[pa.RecordBatch], values: list[str], totals: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its first and last group, and the sums of the last one."""
    carry, part, kinds = _Carry(len(values), len(totals)), None, []
    for batch in batches:
        if batch.num_rows:
            part = batch["_part"][0].as_py()
            own = [_numbers(batch[v]) for v in values]
            kinds = [pa.int64(), *(pa.from_numpy_dtype(np.cumsum(x[:0]).dtype) for x in own), *(batch[t].type for t in totals)]
            carry.read(batch["_k"].to_numpy(), batch["_row"].to_numpy(), own, [batch[t] for t in totals])
    if part is not None:
        held = [pa.array([x], t) for x, t in zip([*carry.sums, *carry.totals], kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([carry.first]), pa.array([carry.key]), *held],
            ["_part", "_first", "_last", "_n", *(f"_o_{i}" for i in range(len(values))), *(f"_u_{i}" for i in range(len(totals)))])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, str],
    rank: str = "rank",
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Add the 1-based ``rank`` and inclusive running sums ``{out: input}`` in
    ``order`` within ``keys`` (no keys: over the whole table), and ``totals`` of
    inputs over the whole group.

    The rows are shuffled once, by ranges of (keys, order), and each partition is
    scanned with its sums carried along.  Only a partition's first group can have
    begun before it: what that had so far is one row for each partition, the only
    table broadcast.  Group totals are summed before the shuffle and travel as a row
    ahead of their group.  Groups are told apart by a 64-bit hash of their keys."""
    keys, totals = list(keys), totals or {}
    whole = {t.name: t.dataType.simpleString() for t in df.schema}
    wide = lambda c: "double" if whole[c] in ("float", "double") else "bigint"
    values, wanted = list(sums.values()), [f"_w_{i}" for i in range(len(totals))]
    body = df.select("*", *[F.lit(None).cast(wide(c)).alias(w) for w, c in zip(wanted, totals.values(), strict=True)], F.lit(1).cast("bigint").alias("_row"))
    if totals:
        ahead = df.groupBy(*keys).agg(*[F.sum(c).cast(wide(c)).alias(w) for w, c in zip(wanted, totals.values(), strict=True)])
        body = body.unionByName(ahead.withColumn("_row", F.lit(0).cast("bigint")), allowMissingColumns=True)
    sort = [*[F.col(k) for k in keys], F.col("_row"), *order]
    marked = body.withColumn("_k", F.xxhash64(*keys) if keys else F.lit(0).cast("bigint"))
    placed = cut_lineage(marked.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_part", F.spark_partition_id()))
    parts = [f"{c} {t}" for c, t in [("_part", "int"), ("_first", "bigint"), ("_last", "bigint"), ("_n", "bigint")]]
    parts += [f"_o_{i} {wide(c)}" for i, c in enumerate(values)] + [f"_u_{i} {wide(c)}" for i, c in enumerate(totals.values())]
    needed = ["_part", "_k", "_row", *dict.fromkeys(values), *wanted]
    ends = placed.select(*needed).mapInArrow(partial(_ends, values=values, totals=wanted), ", ".join(parts))
    # A row for each partition: small whatever the data.
    so_far, before = Window.partitionBy("_last").orderBy("_part"), Window.orderBy("_part")
    held = ["_n", *[f"_o_{i}" for i in range(len(values))]]
    ends = ends.select("_part", "_first", "_last", *[F.sum(c).over(so_far).alias(c) for c in held], *[F.max(f"_u_{i}").over(so_far).alias(f"_u_{i}") for i in range(len(totals))])
    gone = [*held, *[f"_u_{i}" for i in range(len(totals))]]
    ends = ends.select("_part", "_first", F.lag("_last").over(before).alias("_last"), *[F.lag(c).over(before).alias(c) for c in gone]).where("_first = _last")
    local = StructType([*placed.schema, StructField("_head", BooleanType()), StructField("_r", LongType()),
                        *[StructField(f"_s_{i}", DoubleType() if wide(c) == "double" else LongType()) for i, c in enumerate(values)],
                        *[StructField(f"_t_{i}", DoubleType() if wide(c) == "double" else LongType()) for i, c in enumerate(totals.values())]])
    scanned = placed.mapInArrow(partial(_scan, values=values, totals=wanted), local)
    joined = scanned.join(F.broadcast(ends.drop("_first", "_last")), "_part", "left").where("_row = 1")
    plus = lambda own, c: F.col(own) + F.when(F.col("_head"), F.coalesce(c, F.lit(0))).otherwise(0)
    kept = [c for c in df.columns if c not in sums and c not in totals and c != rank]
    return joined.select(
        *kept, plus("_r", "_n").alias(rank), *[plus(f"_s_{i}", f"_o_{i}").alias(o) for i, o in enumerate(sums)],
        *[F.coalesce(f"_t_{i}", F.when(F.col("_head"), F.col(f"_u_{i}"))).alias(o) for i, o in enumerate(totals)])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark cuts each partition to ``n`` per key before
    the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _highest(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, value = batch["_k"].to_numpy(), batch["_v"].to_numpy()
        keep = np.ones(len(key), bool)
        cuts = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(key)]):
            if hi - lo > n:
                run = value[lo:hi]
                keep[lo:hi] = run >= np.partition(run, hi - lo - n)[hi - lo - n]
        yield batch.select(batch.schema.names[:-2]).filter(pa.array(keep))


def highest_of_runs(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """Without rows that cannot be among the ``n`` highest of their key: where rows of a key follow each other, those below the
    n-th of the run go.  Rows equal to it stay, so that any further order can decide.  No sort and no shuffle: for rows that a
    join has just made key by key, before ``first_per_key`` sorts what is left."""
    number = F.col(value).cast("double")
    number = F.when(number.isNull(), float("-inf")).when(F.isnan(number), float("inf")).otherwise(number)
    return df.withColumns({"_k": F.xxhash64(*keys), "_v": number}).mapInArrow(partial(_highest, n=n), df.schema)
