"""Toxicity with a factorization machine over hashed terms.

Terms are the words of a text and two prefix lengths of each, hashed into buckets; a text is the set of its
buckets. The score is the logistic of bias + linear weights + pairwise interactions through short factor
vectors, so that two terms can weigh together what neither does alone.
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

from helixframe.llm.common import CONTINUES, FOLDED_VALUE, chunked, id_remainder, runs, span_hashes, table

BUCKETS, FACTORS = 1 << 18, 4
#: Code points of the two prefixes taken from longer words.
PREFIXES = (4, 6)
#: Labelled texts learnt from, at most, of each label.
SAMPLE = 3000
#: Texts that hold a term with weights, at least.
LEAST_TEXTS = 3
#: Penalties, as shares of what chance alone would reach: the largest of as many linear gradients, the spectral size of
#: the sum of pair gradients. Then steps with them, steps without the linear one, step size, ridge, size of first factors.
LINEAR, PAIRS = 0.5, 0.2
STEPS, REFIT, RATE, RIDGE, START, SEED = 80, 50, 0.1, 0.1, 0.02, 7

_letter = np.zeros(256, bool)
_letter[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") + list(range(128, 256))] = True


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the distinct terms of each text, by row and bucket."""
    start, end, row = runs(_letter[data], at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(~CONTINUES[data])
    of = np.searchsorted(begins, start)
    hashes = [span_hashes(data, start, end, FOLDED_VALUE)]
    rows = [row]
    for k in PREFIXES:
        cut = np.append(begins, len(data))[np.minimum(of + k, len(begins))]
        longer = cut < end
        hashes.append(span_hashes(data, start[longer], cut[longer], FOLDED_VALUE) + np.uint64(k))
        rows.append(row[longer])
    key = np.unique(np.concatenate(rows).astype(np.int64) * BUCKETS + (np.concatenate(hashes) >> np.uint64(46)).astype(np.int64))
    return key % BUCKETS, key // BUCKETS


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, bucket: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        linear = np.bincount(row, self.linear[bucket], n)
        v = self.factors[bucket]
        pairs = sum(np.bincount(row, v[:, f], n) ** 2 - np.bincount(row, v[:, f] ** 2, n) for f in range(v.shape[1]))
        return self.bias + linear + 0.5 * pairs


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _log_odds(p: np.ndarray | float) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


class Terms:
    """Texts by terms of weight, in both orders; sums of values of entries by text and by term."""

    def __init__(self, features: list[np.ndarray], used: np.ndarray):
        index = np.full(BUCKETS, -1)
        index[used] = np.arange(len(used))
        rows = [x[x >= 0] for x in (index[f] for f in features)]
        self.n, self.used = len(rows), used
        self.size = np.array([len(x) for x in rows])
        self.term = np.concatenate(rows)
        self.text = np.repeat(np.arange(self.n), self.size)
        self.held = np.bincount(self.term, minlength=len(used))
        self.by_term = self.text[np.argsort(self.term, kind="stable")]

    def of_texts(self, value: np.ndarray) -> np.ndarray:
        """Sum over the terms of each text of a value of the term."""
        out = np.zeros((self.n, *value.shape[1:]), value.dtype)
        full = self.size > 0
        out[full] = np.add.reduceat(value[self.term], (np.cumsum(self.size) - self.size)[full], axis=0)
        return out

    def of_terms(self, value: np.ndarray) -> np.ndarray:
        """Sum over the texts of each term of a value of the text."""
        return np.add.reduceat(value[self.by_term], np.cumsum(self.held) - self.held, axis=0)


class Adam:
    """Steps along the mean gradient, over the root of the mean square."""

    def __init__(self):
        self.mean, self.square, self.t = 0.0, 0.0, 0

    def step(self, grad):
        """(step to subtract, step size of each weight)."""
        self.t += 1
        self.mean, self.square = 0.9 * self.mean + 0.1 * grad, 0.99 * self.square + 0.01 * grad ** 2
        rate = RATE / (np.sqrt(self.square / (1 - 0.99 ** self.t)) + 1e-8)
        return rate * self.mean / (1 - 0.9 ** self.t), rate


def train(features: list[np.ndarray], label: np.ndarray) -> FactorizationMachine:
    """Weights of all terms of ``LEAST_TEXTS`` texts, by steps over all texts at once.

    Linear weights have an absolute penalty in the scale of each term, so that a term that follows the labels no better
    than the best of as many chance terms comes to 0. The factors' ridge is a penalty on the singular values of the
    matrix of pairs: pairs stay that matter together beyond what all chance pairs make. Then the terms that are left are
    fitted once more without the linear penalty."""
    share = label.mean()
    spread = share * (1 - share)
    held = np.bincount(np.concatenate(features), minlength=BUCKETS)
    data = Terms(features, np.flatnonzero(held >= LEAST_TEXTS))
    linear, factors = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)
    b = float(_log_odds(share))
    if not len(data.used):
        return FactorizationMachine(b, linear, factors)
    chance = LINEAR * np.sqrt(2 * np.log(max(2, len(data.used))) * spread * data.held * (1 - data.held / data.n))
    pairs = PAIRS * np.sqrt(spread * (data.size.astype(float) ** 2).sum())
    w = np.zeros(len(data.used), np.float32)
    v = np.random.default_rng(SEED).normal(0, START, (len(w), FACTORS)).astype(np.float32)
    by_bias, by_linear, by_factors = Adam(), Adam(), Adam()
    for step in range(STEPS + REFIT):
        if step == STEPS:
            # What came to nothing goes: linear weights of 0 stay so, factors below their first size are 0.
            v[np.sqrt((v ** 2).sum(axis=1)) < START] = 0
            left = (w != 0) | (v != 0).any(axis=1)
            if not left.any():
                break
            data, w, v, open_ = Terms(features, data.used[left]), w[left], v[left], w[left] != 0
            by_factors.mean, by_factors.square = by_factors.mean[left], by_factors.square[left]
            by_linear.mean, by_linear.square = by_linear.mean[left] * open_, by_linear.square[left]
        sums = data.of_texts(v)
        logit = b + data.of_texts(w) + 0.5 * ((sums ** 2).sum(axis=1) - data.of_texts((v ** 2).sum(axis=1)))
        d = (sigmoid(logit) - label).astype(np.float32)
        both = data.of_terms(np.column_stack((d[:, None] * sums, d)))
        grad = both[:, -1]
        if step < STEPS:
            move, rate = by_linear.step(grad)
            w = w - move
            w = np.sign(w) * np.maximum(np.abs(w) - rate * chance, 0).astype(np.float32)
        else:
            w = w - by_linear.step((grad + RIDGE * w) * open_)[0]
        v = v - by_factors.step(both[:, :-1] - v * grad[:, None] + pairs * v)[0] * (v != 0).any(axis=1)[:, None]
        b -= float(by_bias.step(d.sum())[0])
    linear[data.used], factors[data.used] = w, v
    return FactorizationMachine(b, linear, factors)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[np.ndarray] = []
        for lo, hi, data, at in chunked(batch.column(1)):
            bucket, row = terms(data, at)
            out += np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, hi - lo)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["label", "terms"])


def fit(docs: DataFrame, marks: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Learn from whole texts of ``docs`` (doc_id, text) as ``marks`` (doc_id, label 0/1) says.

    Of each label at most ``sample`` marks are taken, by a hash of the id, before any text is read; this bounds what
    is broadcast and what reaches the driver. The bias is set back to the share of the labels among all marks. Rows with a NULL id or label teach nothing. Without both labels the
    model is the plain share of label 1."""
    marks = marks.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    have = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, 1.5 * sample / have.get(1, 1)).otherwise(1.5 * sample / have.get(0, 1))
    near = marks.where(F.pmod("h", F.lit(1 << 20)) / (1 << 20) < share)
    near = near.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy("h", "doc_id"))).where(F.col("k") <= sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(near.select("doc_id", "label")), "doc_id")
    got = texts.select("label", "text").mapInArrow(_features, "label int, terms array<int>").toArrow()
    label = got.column("label").to_numpy().astype(float)
    if len(set(label)) < 2:
        share = (label.sum() + 1) / (len(label) + 2)
        return FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    features = [np.asarray(x, np.int64) for x in got.column("terms").to_numpy()]
    order = np.lexsort(([int(x.sum()) for x in features], [len(x) for x in features], label))  # whatever order the rows came in
    model = train([features[i] for i in order], label[order])
    rate = {k: min(1.0, sample / have[k]) for k in (0, 1)}
    model.bias -= float(np.log(rate[1] / rate[0]))
    return model


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for lo, hi, data, at in chunked(batch.column(1)):
            bucket, row = terms(data, at)
            out[lo:hi] = sigmoid(model.value.logits(bucket, row, hi - lo))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], ["doc_id", "held_out", "score"])


def score(docs: DataFrame, model: FactorizationMachine, held_out=None) -> DataFrame:
    """(doc_id, held_out, score) of every row; a NULL or empty text gets the bias alone.

    One pass, no shuffle; repeated rows give repeated rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint"), "text", held).mapInArrow(partial(_score, model=shared), "doc_id bigint, held_out boolean, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = fit(docs, marks.where(~held))
    return score(docs, model, held).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
