"""Motif matrices as rows (motif_id, pos, a, c, g, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.pwm import ACGT, argmax_base, normalized, row_ic, settled
from helixframe.functions.strict import refuse


def _cols(prefix: str = ""):
    return [F.col(prefix + b) for b in ACGT]


def motif_lengths(rows: DataFrame, key: str = "motif_id") -> DataFrame:
    return rows.groupBy(key).agg((F.max("pos") + 1).alias("m"))


def normalize_pwm(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of shares: cells clipped from below, over their sum.  ``strict``: a missing cell, one that is no number, is
    infinite or below zero, or a gap in the positions of a motif fails the call, with the number of such rows."""
    if strict:
        cells = [F.when(F.col(b).isNull() | F.isnan(b) | (F.abs(b) == float("inf")) | (F.col(b) < 0), F.lit(b.upper())) for b in ACGT]
        wrong = F.array_compact(F.array(*cells))
        where = F.concat(*([F.col("motif_id").cast("string"), F.lit(" ")] if "motif_id" in rows.columns else []), F.lit("row "), F.col("pos").cast("string"))
        refuse(rows, F.when(F.size(wrong) > 0, F.concat(where, F.lit(": no shares in "), F.array_join(wrong, ","))), "unusable matrix rows")
        if "motif_id" in rows.columns:
            whole = rows.groupBy("motif_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("k"), (F.max("pos") + 1).alias("m"), F.min("pos").alias("lo"))
            refuse(whole, F.when((F.col("n") != F.col("m")) | (F.col("k") != F.col("m")) | (F.col("lo") != 0), F.concat(F.col("motif_id").cast("string"), F.lit(": positions are not 0 to M-1"))), "matrices with missing rows")
    keep = [c for c in rows.columns if c not in ACGT]
    return rows.select(*keep, *[c.alias(b) for b, c in zip(ACGT, normalized(_cols()))])


def information_content(rows: DataFrame) -> DataFrame:
    return settled(rows, [c for c in rows.columns if c != "ic"], {"ic": row_ic(_cols())})


def reverse_complement_pwm(rows: DataFrame, key: str = "motif_id") -> DataFrame:
    """pos -> M-1-pos with A<->T and C<->G; M joined back per motif."""
    return rows.join(motif_lengths(rows, key), key).select(
        *[c for c in rows.columns if c not in (*ACGT, "pos")],
        (F.col("m") - 1 - F.col("pos")).alias("pos"),
        F.col("t").alias("a"), F.col("g").alias("c"), F.col("c").alias("g"), F.col("a").alias("t"))


def trim_pwm(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop end rows until both ends carry more than ``threshold`` bits."""
    ic = information_content(rows)
    informative = ic.where(F.col("ic") > threshold)
    ends = informative.groupBy("motif_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    return ic.join(ends, "motif_id").where(F.col("pos").between(F.col("lo"), F.col("hi"))).select(
        "motif_id", (F.col("pos") - F.col("lo")).alias("pos"), *ACGT, "ic")


def pack(rows: DataFrame, key: str = "motif_id", extra: list[str] | None = None) -> DataFrame:
    """One row per motif: ``rows`` ARRAY<STRUCT<pos,a,c,g,t,...>> in order."""
    fields = ["pos", *ACGT, *(extra or [])]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))


def consensus_sequence(rows: DataFrame) -> DataFrame:
    lettered = rows.select("motif_id", "pos", argmax_base(_cols()).alias("letter"))
    return lettered.groupBy("motif_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "letter"))).getField("letter"), "").alias("consensus"))


def complement(seq):
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq):
    return F.reverse(complement(seq))


def _motif_key(base_rows: DataFrame) -> list[str]:
    return [c for c in ("path", "motif_id") if c in base_rows.columns]


def base_row_checks(base_rows: DataFrame) -> DataFrame:
    """Per motif: the four base rows, with an ``error`` when they cannot form a
    matrix.  ``base_rows``: motif_id, ord, base, values ARRAY<DOUBLE>; a base given
    twice keeps its last row.  With a column ``path`` each file's motifs stand alone."""
    per = base_rows.groupBy(*_motif_key(base_rows)).agg(
        *[F.expr(f"max_by(values, ord) FILTER (WHERE base = '{b.upper()}')").alias(f"row_{b}") for b in ACGT])
    present = F.array(*[F.when(F.col(f"row_{b}").isNull(), b.upper()) for b in ACGT])
    missing = F.array_compact(present)
    sizes = F.array_sort(F.array_distinct(F.array(*[F.size(f"row_{b}") for b in ACGT])))
    return per.withColumn(
        "error",
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing base rows: "), F.array_join(missing, ", ")))
        .when(F.size(sizes) > 1,
              F.concat(F.lit("Base rows have inconsistent lengths: ["), F.array_join(sizes.cast("array<string>"), ", "), F.lit("]")))
        .when(sizes[0] == 0, F.lit("PWM has zero columns")))


def base_rows_to_pwm(base_rows: DataFrame) -> DataFrame:
    """Transpose four base rows into motif rows; faulty motifs give no rows
    (``pwm_validate`` lists them)."""
    ok = base_row_checks(base_rows).where(F.col("error").isNull())
    zipped = F.arrays_zip(*[F.col(f"row_{b}").alias(f"row_{b}") for b in ACGT])
    keys = _motif_key(base_rows)
    return ok.select(*keys, F.posexplode(zipped).alias("pos", "v")).select(
        *keys, "pos", *[F.col(f"v.row_{b}").alias(b) for b in ACGT])


def pwm_validate(base_rows: DataFrame) -> DataFrame:
    return base_row_checks(base_rows).where(F.col("error").isNotNull()).select("motif_id", "error")
