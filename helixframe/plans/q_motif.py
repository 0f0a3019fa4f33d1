"""Queries on motif matrices and sequence strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.pwm import ACGT
from helixframe.operators import motif as M
from helixframe.plans import views as V
from helixframe.plans.common import big, r6, table, with_ctes

PWM = [V.SQL_PWM]
IC = "2 + a*log2(a) + c*log2(c) + g*log2(g) + t*log2(t)"


def _rounded(df, *more):
    return df.select("motif_id", big("pos").alias("pos"), *[r6(b).alias(b) for b in ACGT], *more)


def normalize_pwm(spark, sf):
    """Raw absolute values in, normalised rows out."""
    e = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("motif_id"), F.col("embedding").cast("array<double>").alias("e"),
        F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    raw = e.select("motif_id", "pos", *[F.abs(F.expr(f"e[4*pos+{k}]")).alias(b) for k, b in enumerate(ACGT)])
    return _rounded(M.normalize_pwm(raw))


def information_content(spark, sf):
    return M.information_content(V.pwm(spark, sf)).select("motif_id", big("pos").alias("pos"), r6("ic").alias("ic"))


def reverse_complement_pwm(spark, sf):
    return _rounded(M.reverse_complement_pwm(V.motifs(spark, sf)))


def trim_pwm(spark, sf):
    return _rounded(M.trim_pwm(V.pwm(spark, sf)), r6("ic").alias("ic"))


def consensus_sequence(spark, sf):
    return M.consensus_sequence(V.motifs(spark, sf))


def complement(spark, sf):
    return V.text_chains(spark, sf).select("sample_id", "chain", M.complement("sequence").alias("complement"))


def reverse_complement(spark, sf):
    return V.text_chains(spark, sf).select("sample_id", "chain", M.reverse_complement("sequence").alias("reverse_complement"))


def _base_rows(spark, sf):
    """Four base rows per motif, some motifs made faulty."""
    fault = F.expr("CASE WHEN motif_id % 13 = 5 THEN 1 WHEN motif_id % 17 = 3 THEN 2 WHEN motif_id % 19 = 2 THEN 3 ELSE 0 END")
    long = V.pwm(spark, sf).select("motif_id", "pos", F.explode(F.array(*[
        F.struct(F.lit(k).alias("ord"), F.lit(b.upper()).alias("base"), F.col(b).alias("v")) for k, b in enumerate(ACGT)])).alias("r"))
    rows = long.groupBy("motif_id", "r.ord", "r.base").agg(
        F.array_sort(F.collect_list(F.struct("pos", "r.v"))).getField("v").alias("values"))
    values = (F.when((fault == 2) & (F.col("base") == "T"), F.slice("values", 1, F.size("values") - 1))
              .when(fault == 3, F.slice("values", 1, 0)).otherwise(F.col("values")))
    return rows.where(~((fault == 1) & (F.col("base") == "G"))).withColumn("values", values)


def base_rows_to_pwm(spark, sf):
    return _rounded(M.base_rows_to_pwm(_base_rows(spark, sf)))


def pwm_validate(spark, sf):
    return M.pwm_validate(_base_rows(spark, sf))


QUERIES = {
    "normalize_pwm": normalize_pwm, "information_content": information_content,
    "reverse_complement_pwm": reverse_complement_pwm, "trim_pwm": trim_pwm,
    "consensus_sequence": consensus_sequence, "complement": complement, "reverse_complement": reverse_complement,
    "base_rows_to_pwm": base_rows_to_pwm, "pwm_validate": pwm_validate,
}

_R = "round(a,6) AS a, round(c,6) AS c, round(g,6) AS g, round(t,6) AS t"
_FAULT = "CASE WHEN motif_id % 13 = 5 THEN 1 WHEN motif_id % 17 = 3 THEN 2 WHEN motif_id % 19 = 2 THEN 3 ELSE 0 END"

ORACLES = {
    "normalize_pwm": with_ctes(PWM, f"SELECT motif_id, pos, {_R} FROM v_pwm"),
    "information_content": with_ctes(PWM, f"SELECT motif_id, pos, round({IC}, 6) AS ic FROM v_pwm"),
    "reverse_complement_pwm": with_ctes([V.SQL_PWM, V.SQL_MOTIF], """SELECT v.motif_id, m - 1 - pos AS pos,
        round(t,6) AS a, round(g,6) AS c, round(c,6) AS g, round(a,6) AS t
        FROM v_motif v JOIN (SELECT motif_id, max(pos) + 1 AS m FROM v_motif GROUP BY ALL) USING (motif_id)"""),
    "trim_pwm": with_ctes([V.SQL_PWM, f"v_ic AS (SELECT *, {IC} AS ic FROM v_pwm)"], f"""SELECT motif_id, pos - lo AS pos, {_R}, round(ic,6) AS ic
        FROM (SELECT *, min(pos) FILTER (WHERE ic > 0.5) OVER (PARTITION BY motif_id) AS lo,
                        max(pos) FILTER (WHERE ic > 0.5) OVER (PARTITION BY motif_id) AS hi FROM v_ic) WHERE pos BETWEEN lo AND hi"""),
    "consensus_sequence": with_ctes([V.SQL_PWM, V.SQL_MOTIF], """SELECT motif_id, string_agg(
        CASE WHEN a >= c AND a >= g AND a >= t THEN 'A' WHEN c >= g AND c >= t THEN 'C' WHEN g >= t THEN 'G' ELSE 'T' END, '' ORDER BY pos) AS consensus
        FROM v_motif GROUP BY motif_id"""),
    "complement": with_ctes([V.SQL_CHAIN], "SELECT sample_id, chain, translate(sequence, 'ACGT', 'TGCA') AS complement FROM v_chain"),
    "reverse_complement": with_ctes([V.SQL_CHAIN], "SELECT sample_id, chain, reverse(translate(sequence, 'ACGT', 'TGCA')) AS reverse_complement FROM v_chain"),
    "base_rows_to_pwm": with_ctes(PWM, f"SELECT motif_id, pos, {_R} FROM v_pwm WHERE {_FAULT} = 0"),
    "pwm_validate": f"""SELECT motif_id, ['Missing base rows: G', 'Base rows have inconsistent lengths: [15, 16]', 'PWM has zero columns'][f] AS error
        FROM (SELECT motif_id, {_FAULT} AS f FROM (SELECT vec_id AS motif_id FROM embeddings)) WHERE f > 0""",
}
