"""Language identification with interpolated Kneser-Ney character models.

One model per language over folded letters (every run of other characters is one blank). Counts come from a
sample of labelled texts, bounded per language. Probabilities of all n-grams seen in any language are worked
out once and stored, for every order, as a sorted array of hashed n-grams beside a row of log probabilities;
contexts have the interpolation weights in the same form. A text gets the language of least cross-entropy a
letter and is rejected if that is too high for a text of its length in that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import CONTINUES, chunked, id_remainder, mix64, small_enough, stored, table

ORDER = 4
#: Labelled texts learnt from, at most, for each language; a fifth more calibrate the rejection.
SAMPLE = 1000
#: A text is rejected so many standard deviations above the usual cross-entropy, and at least so many nats.
REJECT_Z, REJECT_NATS = 8.0, 1.0
#: Sharpness of the score: softmax of minus this times the cross-entropy (nats a letter).
SHARP = 8.0
CHUNK = 1 << 18

_fold: np.ndarray | None = None


def fold() -> np.ndarray:
    """Letter of each code point below 65,536 in lower case, 0 for other characters."""
    global _fold
    if _fold is None:
        lower = [chr(c).lower() if chr(c).isalpha() else "\0" for c in range(0x10000)]
        _fold = np.array([ord(x[0]) if ord(x[0]) < 0x10000 else 0xFFFF for x in lower], np.uint64)
    return _fold


def letters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram, row): what each letter or blank follows, packed in 64 bits; n-grams never cross texts."""
    lead = ORDER - 1
    padded = np.insert(data, np.repeat(at[:-1], lead), 10)
    points = np.frombuffer(padded.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.concatenate(([0], np.cumsum(~CONTINUES[padded])))[at[:-1] + lead * np.arange(len(at) - 1)]
    code = fold()[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        code[i] = 0xFFFF if chr(points[i]).isalpha() else 0
    first = np.zeros(len(code), bool)
    for k in range(lead):
        first[begins + k] = True
    keep = first | (code > 0)
    keep[1:] |= code[:-1] > 0
    row = np.cumsum(np.bincount(begins, minlength=len(code))) - 1
    code, row, first = code[keep], row[keep], first[keep]
    key = code.copy()
    for k in range(1, ORDER):
        key[k:] |= code[:-k] << np.uint64(16 * k)
    return key[~first], row[~first]


def low(key: np.ndarray, order: int) -> np.ndarray:
    return key if order == 4 else key & np.uint64((1 << (16 * order)) - 1)


def find(known: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, found) in a sorted array."""
    if not len(known):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    return at, known[at] == key


class HashArray:
    """Values by sorted hash. As hashes are even, their leading 16 bits lead close to the place."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        hashes = mix64(key)
        by = np.argsort(hashes)
        self.hashes = np.append(hashes[by], np.uint64(2**64 - 1))
        self.value = np.concatenate([value[by], np.zeros_like(value[:1])])
        self.start = np.searchsorted(hashes[by], np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))

    def take(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of values, found); rows of keys that are not there mean nothing."""
        want = mix64(key)
        at = self.start[(want >> np.uint64(48)).astype(np.int64)]
        left = np.flatnonzero(self.hashes[at] < want)
        while len(left):
            at[left] += 1
            left = left[self.hashes[at[left]] < want[left]]
        return self.value.take(at, axis=0), (self.hashes[at] == want) & (at < len(self.hashes) - 1)


@dataclass
class LanguageModel:
    """langs; for each order log probabilities by n-gram and log weights by context; the rejection rule."""

    langs: list[str]
    grams: list[HashArray]
    contexts: list[HashArray]
    unseen: np.ndarray
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None
    a_letter: np.ndarray | None = None

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        out, hit = self.grams[ORDER - 1].take(key)
        left = np.flatnonzero(~hit)
        out[left] = 0
        for order in range(ORDER, 0, -1):
            k = low(key[left], order)
            if order < ORDER:
                value, hit = self.grams[order - 1].take(k)
                out[left[hit]] += value[hit]
                left, k = left[~hit], k[~hit]
            if order > 1 and len(left):
                value, hit = self.contexts[order - 1].take(k >> np.uint64(16))
                out[left[hit]] += value[hit]
        out[left] += self.unseen
        return out

    def cross_entropy(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(nats a letter for each language, letters and blanks predicted) of each text; 0 letters if it has none."""
        total, size = np.zeros((len(column), len(self.langs))), np.zeros(len(column), np.int64)
        for lo, hi, data, at in chunked(column, CHUNK):
            key, row = letters(data, at)
            real = np.bincount(row, low(key, 1) > 0, hi - lo)
            size[lo:hi] = np.bincount(row, minlength=hi - lo) * (real > 0)
            if len(row):
                start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                total[lo + row[start]] = np.add.reduceat(self.log_probabilities(key), start, axis=0, dtype=np.float64)
        return -total / np.maximum(size, 1)[:, None], size


class _Counts:
    """Kneser-Ney counts of one language at each order: the highest as seen, the others by distinct left neighbours."""

    def __init__(self, key: np.ndarray, count: np.ndarray):
        self.tables, self.contexts = [None] * ORDER, [None] * ORDER
        for order in range(ORDER, 0, -1):
            by = np.argsort(key)
            key, count = key[by], count[by].astype(np.float64)
            ones, twos = max(1, (count == 1).sum()), max(1, (count == 2).sum())
            discount = ones / (ones + 2 * twos)
            context, group = np.unique(key >> np.uint64(16) if order > 1 else key * np.uint64(0), return_inverse=True)
            self.tables[order - 1] = (key, np.maximum(count - discount, 0))
            self.contexts[order - 1] = (context, np.bincount(group, count), np.bincount(group) * discount)
            key, count = np.unique(low(key, order - 1), return_counts=True) if order > 1 else (key, count)

    def weight(self, order: int, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the context's counts, interpolation weight); weight 1 for a new context."""
        known, total, held = self.contexts[order - 1]
        at, hit = find(known, context)
        return np.where(hit, total[at], 0), np.where(hit, held[at] / total[at], 1.0)

    def probability(self, order: int, key: np.ndarray) -> np.ndarray:
        if order == 0:
            return np.full(len(key), 1 / 0x10000)
        lower = self.probability(order - 1, low(key, order - 1) if order > 1 else key)
        total, weight = self.weight(order, key >> np.uint64(16) if order > 1 else key * np.uint64(0))
        known, count = self.tables[order - 1]
        at, hit = find(known, key)
        return np.where(hit, count[at], 0) / np.maximum(total, 1) + weight * lower


def _build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    langs = sorted(counts)
    each = [_Counts(*counts[x]) for x in langs]
    grams, contexts = [], []
    for order in range(1, ORDER + 1):
        key = np.unique(np.concatenate([c.tables[order - 1][0] for c in each]))
        context = np.unique(np.concatenate([c.contexts[order - 1][0] for c in each]))
        for known, of, into in ((key, lambda c, o=order: np.log(c.probability(o, key)), grams), (context, lambda c, o=order: np.log(c.weight(o, context)[1]), contexts)):  # noqa: B023
            into.append(HashArray(known, np.stack([of(c) for c in each], axis=1).astype(np.float32)))
    unseen = np.log([c.weight(1, np.zeros(1, np.uint64))[1][0] / 0x10000 for c in each]).astype(np.float32)
    return LanguageModel(langs, grams, contexts, unseen)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            column = batch.column(1).filter(pa.array([x == lang for x in langs]))
            parts = [letters(data, at)[0] for _, _, data, at in chunked(column, CHUNK)]
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def _entropies(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ce, size = model.value.cross_entropy(batch.column(1))
        own = np.array([model.value.langs.index(x) for x in batch.column(0).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ce[np.arange(len(own)), own]), pa.array(size)], ["lang", "ce", "size"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """A model from (doc_id, text, lang): at most ``sample`` texts a language, chosen by a hash of the id, whole.

    Rows without language, id or text teach nothing; None if there is nothing to learn from. The sample, and so
    what reaches the driver (counts of its distinct n-grams), does not grow with the table."""
    rows = labelled.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", "text").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    have = small_enough(stored(rows.groupBy("lang").agg(F.count("*").alias("have"))))
    share = F.lit(2.0 * sample) / F.col("have")  # 1.2 are wanted; the rest is slack for chance
    near = rows.join(have, "lang").where((F.pmod("h", F.lit(1 << 20)) / (1 << 20)) < share)
    near = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("k") <= 1.2 * sample)
    use = near.select("lang", "text", (F.col("k") % 6 == 0).alias("calibrates")).where("text IS NOT NULL")
    counted = use.where("NOT calibrates").select("lang", "text").mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        return None
    model = _build({x: (g["gram"].to_numpy().view(np.uint64), g["n"].to_numpy()) for x, g in counted.groupby("lang")})
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    seen = use.where(F.col("calibrates") & F.col("lang").isin(model.langs)).select("lang", "text").mapInArrow(partial(_entropies, model=shared), "lang string, ce double, size bigint").where("size > 0").toPandas()
    model.usual, model.spread, model.a_letter = np.full(len(model.langs), np.inf), np.zeros(len(model.langs)), np.zeros(len(model.langs))
    for i, x in enumerate(model.langs):
        own = seen[seen["lang"] == x]
        if len(own) >= 3:
            ce, size = own["ce"].to_numpy(), own["size"].to_numpy()
            long = ce[size >= np.median(size)]
            model.usual[i], model.spread[i] = np.average(ce, weights=size), max(long.std(), 0.01)
            model.a_letter[i] = np.mean(size * (ce - model.usual[i]) ** 2)
    return model


def _predict(batches: Iterator[pa.RecordBatch], model, kept: list[str]) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        n = batch.num_rows
        if m is None:
            lang, score, best, rejected = ["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
        else:
            ce, size = m.cross_entropy(batch.column(batch.num_columns - 1))
            i = ce.argmin(axis=1)
            best, none = ce[np.arange(n), i], size == 0
            with np.errstate(invalid="ignore"):
                limit = m.usual[i] + np.maximum(REJECT_NATS, REJECT_Z * np.sqrt(m.spread[i] ** 2 + m.a_letter[i] / np.maximum(size, 1)))
            rejected = none | (best > limit)
            score = np.where(none, 0.0, 1 / np.exp(-SHARP * (ce - best[:, None])).sum(axis=1))
            lang = ["und" if x else m.langs[k] for x, k in zip(none, i, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(best), pa.array(rejected)], [*kept, "lang_pred", "score", "cross_entropy", "rejected"])


def predict(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with lang_pred, score, cross_entropy and rejected, a row for each input row.

    ``und``, score 0 and rejected: texts that are NULL, empty or without a letter, and all texts if the model is
    None. Of equal languages the first by name wins. One pass, no shuffle; columns outside ``keep`` are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string, score double, cross_entropy double, rejected boolean"])
    return docs.select(*keep, F.col("text").alias("_scored")).mapInArrow(partial(_predict, model=shared, kept=list(keep)), schema)


def learners(docs: DataFrame) -> DataFrame:
    return docs.where(id_remainder(F.col("doc_id"), 3) != 1)


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is not rejected; the labels of the stage's input teach."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return predict(rows, fit(learners(docs)), ("row",)).where("NOT rejected").select("row.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(learners(docs))
    held = docs.withColumn("held_out", F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)))
    return predict(held, model, ("doc_id", "held_out"))
