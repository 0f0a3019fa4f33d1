"""Column expressions over motif rows.

A motif row is four DOUBLE columns ``a, c, g, t`` (one motif position).  A packed
motif is ``ARRAY<STRUCT<a,c,g,t>>`` ordered by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.constants import EPS

ACGT = ("a", "c", "g", "t")


def total(cols: Sequence[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def settled(rows: DataFrame, kept: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """``kept`` and ``values``, each computed once a row: explode keeps the optimizer from writing a value's expression
    out in every later one, which grows as the product of the steps."""
    one = F.explode(F.array(F.struct(*[c.alias(name) for name, c in values.items()]))).alias("_v")
    return rows.select(*kept, one).select(*kept, "_v.*")


def normalized(cols: Sequence[Column], eps: float = EPS) -> list[Column]:
    """Clip to eps, then divide by the row sum."""
    clipped = [F.greatest(c, F.lit(eps)) for c in cols]
    s = total(clipped)
    return [c / s for c in clipped]


def row_ic(cols: Sequence[Column]) -> Column:
    """Information content of one normalised row, in bits."""
    return F.lit(2.0) + total([c * F.log2(c) for c in cols])


def row_l1(t: Sequence[Column], p: Sequence[Column]) -> Column:
    return total([F.abs(x - y) for x, y in zip(t, p)])


def row_kl(t: Sequence[Column], p: Sequence[Column]) -> Column:
    return total([x * (F.ln(x) - F.ln(y)) for x, y in zip(t, p)])


def argmax_base(cols: Sequence[Column]) -> Column:
    """Letter of the largest value; the first one wins a tie."""
    arr = F.array(*cols)
    return F.substring(F.lit("ACGT"), F.array_position(arr, F.array_max(arr)).cast("int"), 1)


def softmax(cols: Sequence[Column]) -> list[Column]:
    peak = F.greatest(*cols)
    e = [F.exp(c - peak) for c in cols]
    s = total(e)
    return [x / s for x in e]


def log_softmax(cols: Sequence[Column]) -> list[Column]:
    peak = F.greatest(*cols)
    lse = F.ln(total([F.exp(c - peak) for c in cols]))
    return [c - peak - lse for c in cols]


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Stable binary cross entropy on logits."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
