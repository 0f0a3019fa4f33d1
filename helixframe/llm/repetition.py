"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are taken over the words of a chunk of texts in NumPy. Words that lie
inside an n-gram which occurs twice or more in its text are marked, and the marked characters counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import BYTE_VALUE, CONTINUES, SPACE, chunked, mix64, per_row, powers, rolling, runs, span_hashes, table, words

#: n-gram length: largest share of word characters inside repeated n-grams (all occurrences) of a kept text.
COVERAGE = {5: 0.50, 6: 0.48, 7: 0.46, 8: 0.44, 9: 0.42, 10: 0.40}
#: Largest shares of lines, and of characters in lines, that repeat an earlier line, once so many lines do.
LINES, LINE_CHARS, LEAST_LINES = 0.30, 0.30, 3
#: The contract's window.
WINDOW = 8

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True
NAMES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars", "n_repeat_words"]


def _again(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice in its text; is it not the first there."""
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    own = key ^ mix64(row.astype(np.uint64))
    order = np.argsort(own, kind="stable")  # equal keys stay in text order
    own = own[order]
    same = own[1:] == own[:-1]
    twice[order[1:][same]] = twice[order[:-1][same]] = later[order[1:][same]] = True
    return twice, later


def _repeated(h: np.ndarray, row: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length: the first words of n-grams that occur at least twice in their text.

    A repeated n-gram begins with a repeated shorter one, so each length looks only where the one before it did."""
    out: dict[int, np.ndarray] = {}
    first = None
    for n in lengths:
        if first is None:
            key, first = rolling(h, row, n)
        else:
            first = first[first + n <= len(h)]
            first = first[row[np.minimum(first + n - 1, len(h) - 1)] == row[first]]
            key = np.zeros(len(first), np.uint64)
            for k, p in enumerate(powers(n + 1)[1:]):
                key += h[first + k] * p
            key = mix64(key)
        out[n] = first = first[_again(key, row[first])[0]]
    return out


def _covered(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the n-grams that begin at ``first``."""
    change = np.bincount(first, minlength=size + 1) - np.bincount(first + n, minlength=size + 1)
    return np.cumsum(change[:size]) > 0


def _measure(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    names = NAMES + [f"chars_{n}" for n in lengths]
    for batch in batches:
        out = {name: np.zeros(batch.num_rows, np.int64) for name in names}
        for lo, hi, data, at in chunked(batch.column(1)):
            n = hi - lo
            start, end, row, h = words(data, at, BYTE_VALUE)
            points = np.concatenate(([0], np.cumsum(~CONTINUES[data])))
            chars = points[end] - points[start]
            symbols = np.concatenate(([0], np.cumsum(_symbol[data])))
            got = {"n_words": per_row(row, n), "word_chars": per_row(row, n, chars), "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}
            covered = {k: _covered(first, k, len(h)) for k, first in _repeated(h, row, sorted({WINDOW, *lengths})).items()}
            got["n_repeat_words"] = per_row(row, n, covered[WINDOW])
            got |= {f"chars_{k}": per_row(row, n, covered[k] * chars) for k in lengths}
            first, last, of = runs(data != 10, at)
            worded = np.concatenate(([0], np.cumsum(~SPACE[data])))
            full = worded[last] > worded[first]
            first, last, of = first[full], last[full], of[full]
            _, later = _again(span_hashes(data, first, last), of)
            size = points[last] - points[first]
            got |= {"n_lines": per_row(of, n), "n_dup_lines": per_row(of, n, later), "line_chars": per_row(of, n, size), "dup_line_chars": per_row(of, n, size * later)}
            for name, value in got.items():
                out[name][lo:hi] = value
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[x]) for x in names)], ["doc_id", *names])


def repetition(docs: DataFrame, lengths: tuple[int, ...] = tuple(COVERAGE)) -> DataFrame:
    """(doc_id, counts): words, their characters, symbols, lines and repeated lines with a word, words in repeated
    8-word windows, and for each length the word characters inside repeated n-grams.

    NULL and empty texts count zero everywhere; repeated rows give repeated rows; other columns are ignored.
    No shuffle; a chunk of about a megabyte of texts is in memory at once (one longer text alone)."""
    schema = ", ".join(f"{x} bigint" for x in ["doc_id", *NAMES, *(f"chars_{n}" for n in lengths)])
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(partial(_measure, lengths=lengths), schema)


def verdict(counts: DataFrame) -> DataFrame:
    """Adds base_failed and kept: a text is kept if no share of repeated characters or lines is over its bound."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    lines = (F.col("n_dup_lines") > LINES * F.col("n_lines")) | (F.col("dup_line_chars") > LINE_CHARS * F.col("line_chars"))
    bad = (F.col("n_dup_lines") >= LEAST_LINES) & lines
    for n, most in COVERAGE.items():
        bad = bad | (F.col(f"chars_{n}") > most * F.col("word_chars"))
    return counts.withColumn("base_failed", base).withColumn("kept", ~base & ~bad)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(repetition(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *(f"chars_{n}" for n in COVERAGE))
