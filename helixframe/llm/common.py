"""Shared pieces: fixed-size text chunks, word hashing in NumPy, row helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.checkpoints import ensure_checkpoint_dir

#: Bytes of text worked on at once inside a task (one longer text makes one chunk).
CHUNK_BYTES = 1 << 20
#: Rows (of a few numbers each) up to which a computed side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Word pattern of the contracts: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % n


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, items: str | None = None) -> DataFrame:
    """Broadcast hint only after counting the rows of an already written table, and the entries of its array
    column ``items`` (five a row on average at most)."""
    if df.limit(rows + 1).count() > rows:
        return df
    if items and (df.agg(F.sum(F.size(items))).first()[0] or 0) > 5 * rows:
        return df
    return F.broadcast(df)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random-looking value for each byte, and for each byte with A-Z folded.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FOLD = np.arange(256)
FOLD[65:91] += 32
FOLDED_VALUE = BYTE_VALUE[FOLD]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that continue a code point.
CONTINUES = (np.arange(256) & 0xC0) == 0x80

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of a fixed odd number modulo 2**64, kept for the process."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 4096), 0xD6E8FEB86659FD93, np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers[:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    at = at.astype(np.int64) if len(at) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def chunked(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0): whole texts, about ``limit`` bytes together."""
    data, at = texts(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of True, which never cross from one text to the next."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each byte span; spans may be empty but do not overlap."""
    size = end - start
    total = int(size.sum())
    out = np.zeros(len(start), np.uint64)
    if total:
        first = np.cumsum(size) - size
        within = np.arange(total) - np.repeat(first, size)
        at = np.repeat(start, size) + within
        part = value[data[at]] * powers(int(size.max()))[within]
        full = size > 0
        out[full] = np.add.reduceat(part, first[full])
    return mix64(out + mix64(size.astype(np.uint64)))


def words(data: np.ndarray, at: np.ndarray, value: np.ndarray = FOLDED_VALUE, space: np.ndarray = SPACE):
    """(start, end, row, hash) of the words of a chunk."""
    start, end, row = runs(~space[data], at)
    return start, end, row, span_hashes(data, start, end, value)


def rolling(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text, and where each begins."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    total = np.zeros(m, np.uint64)
    for k, p in enumerate(powers(n + 1)[1:]):
        total += h[k:k + m] * p
    where = np.flatnonzero(row[:m] == row[n - 1:])
    return mix64(total[where]), where


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, n).astype(np.int64)


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lineage ends, sizes are known, lost executors lose nothing."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_key(doc_id: Column, text: Column) -> Column:
    """Names a row by id and text; rows that share both are one and the same to an operator."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)))
