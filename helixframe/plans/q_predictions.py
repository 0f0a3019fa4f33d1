"""Queries on prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import predictions as P
from helixframe.plans import views as V
from helixframe.plans.common import big, joined, r6, table, with_ctes
from helixframe.plans.q_align import TEXT, _text, cand_ctes, score_ctes, _SEQBEST, _SLOTS
from helixframe.plans.q_metrics import EVAL_IN, eval_inputs
from helixframe.operators import align as A

ENERGY = ["e_a", "e_c", "e_g", "e_t"]
LOSSES = ["loss", "loss_pwm", "loss_pwm_teacher", "loss_A", "loss_A_base", "loss_A_backbone", "loss_site", "loss_sparse", "loss_noncontact"]


def ensemble_mean(spark, sf):
    vals = ["base_logit", "backbone_logit", *ENERGY]
    return P.ensemble_mean(V.model_cells(spark, sf), ["sample_id", "res_idx", "slot"], vals, expected=2).select(
        "sample_id", big("res_idx").alias("res_idx"), big("slot").alias("slot"), "n_models", *[r6(v, 12).alias(v) for v in vals], "error")


def _cells(spark, sf):
    return eval_inputs(spark, sf)[0]


def gated_energy_pwm(spark, sf):
    out = P.gated_energy_pwm(P.contact_scores(V.predictions(spark, sf)))
    return out.select("sample_id", big("slot").alias("slot"), *[r6(f"p_{b}").alias(f"p_{b}") for b in "acgt"])


def contact_site_scores(spark, sf):
    out = P.site_scores(P.contact_scores(V.predictions(spark, sf)))
    return out.select("sample_id", big("res_idx").alias("res_idx"), r6("site_score").alias("site_score"), r6("site_prob").alias("site_prob"))


def masked_losses(spark, sf):
    out = P.masked_losses(_cells(spark, sf), V.sample_pwm(spark, sf))
    return out.select("sample_id", *[r6(c).alias(c) for c in LOSSES])


def teacher_gate_pwm(spark, sf):
    cells = _cells(spark, sf).withColumn("base_mask", F.col("base_mask") * F.col("pwm_mask"))
    out = P.teacher_gate_pwm(cells)
    return out.select("sample_id", big("slot").alias("slot"), *[r6(f"p_{b}").alias(f"p_{b}") for b in "acgt"])


def _epochs(spark, sf):
    ev = table(spark, sf, "events").select(F.dayofyear("ts").alias("epoch"), F.col("value").alias("loss"),
                                           (F.col("value") * 2).alias("loss_pwm"))
    return P.epoch_metrics(ev, ["loss", "loss_pwm"])


def epoch_metrics(spark, sf):
    return _epochs(spark, sf).select(big("epoch").alias("epoch"), r6("loss").alias("loss"), r6("loss_pwm").alias("loss_pwm"))


def best_epoch(spark, sf):
    return P.best_epoch(_epochs(spark, sf)).select(big("epoch").alias("epoch"), r6("loss").alias("loss"))


def foreign_predictions(spark, sf):
    """Placements of the text samples against a foreign sequence of the same sample:
    its first chain that reaches the motif length, oriented by key."""
    chains, scoring = _text(spark, sf)
    best = A.align_sequence_only(chains, scoring).select(
        "sample_id", "chain", F.col("aligned_sequence").alias("target"), F.col("slot_to_dna_index").alias("slots"), "m")
    own = V.text_chains(spark, sf).select("sample_id", "chain", F.col("sequence").alias("own"), "offset")
    j = best.join(own, ["sample_id", "chain"])
    k = F.col("sample_id")
    seq = (F.when(k % 5 == 0, F.col("own")).when(k % 5 == 1, F.translate("own", "ACGT", "TGCA"))
           .when(k % 5 == 2, F.reverse("own")).when(k % 5 == 3, F.reverse(F.translate("own", "ACGT", "TGCA")))
           .otherwise(F.concat(F.lit("GATTACA"), F.lower("own"))))
    # Half of the samples keep usable slot indices (relative to the chain).
    slots = F.transform("slots", lambda s: F.when(s < 0, s).otherwise(s - F.col("offset") + F.when(k % 2 == 0, 0).otherwise(F.length("own"))))
    return j.select("sample_id", "target", slots.alias("slots"), seq.alias("sequence"),
                    F.when(k % 31 == 6, F.col("m") + 1).otherwise(F.col("m")).alias("m"))


def _orient(number):
    return F.get(F.array(*[F.lit(n) for n, _ in P.ORIENTATIONS]), number - 1)


def align_by_slot_index(spark, sf):
    return P.align_by_slot_index(foreign_predictions(spark, sf)).select("sample_id", _orient(F.col("by_index")).alias("orientation"))


def align_by_window(spark, sf):
    return P.align_by_window(foreign_predictions(spark, sf)).select(
        "sample_id", big("by_window.start").alias("start"), _orient(F.col("by_window.orient")).alias("orientation"))


def align_predictions(spark, sf):
    """Mode or error, and the oriented rows of a foreign matrix with a row per letter."""
    at = lambda add: lambda k: (k + F.lit(add)).cast("double")
    rows = F.transform(F.sequence(F.lit(0), F.length("sequence") - 1), lambda k: F.struct(
        *[at(x)(k).alias(b) for b, x in zip("acgt", (0.0, 0.25, 0.5, 0.75))]))
    out = P.align_predictions(foreign_predictions(spark, sf).withColumn("rows", rows))
    return out.select("sample_id", "mode", "error", joined("matrix.a").alias("matrix_a"), joined("matrix.g").alias("matrix_g"))


def top_contact_pairs(spark, sf):
    return P.top_contact_pairs(_cells(spark, sf), "a_base", 5).select(
        "sample_id", big("res_idx").alias("res_idx"), big("slot").alias("slot"), r6("a_base").alias("a_base"), big("base_label").alias("base_label"))


def column_contribution(spark, sf):
    return P.column_contribution(P.contact_scores(V.predictions(spark, sf))).select(
        "sample_id", big("res_idx").alias("res_idx"), big("slot").alias("slot"), r6("share").alias("share"))


def mask_residue_effect(spark, sf):
    cells = P.contact_scores(V.predictions(spark, sf))
    return P.mask_residue_effect(cells).select(
        "sample_id", big("slot").alias("slot"), "which", big("masked_res").alias("masked_res"), r6("kl_shift").alias("kl_shift"))


QUERIES = {
    "ensemble_mean": ensemble_mean, "gated_energy_pwm": gated_energy_pwm, "contact_site_scores": contact_site_scores,
    "masked_losses": masked_losses, "teacher_gate_pwm": teacher_gate_pwm, "epoch_metrics": epoch_metrics, "best_epoch": best_epoch,
    "align_by_slot_index": align_by_slot_index, "align_by_window": align_by_window, "align_predictions": align_predictions,
    "top_contact_pairs": top_contact_pairs, "column_contribution": column_contribution, "mask_residue_effect": mask_residue_effect,
}

PRED = [V.SQL_MODEL, V.SQL_PRED]


def _soft(prefix="l"):
    z = " + ".join(f"exp({prefix}{b})" for b in "acgt")
    return ", ".join(f"round(exp({prefix}{b}) / ({z}), 6) AS p_{b}" for b in "acgt")


_GATE = """tg AS (SELECT c.*, CASE WHEN max(base_label * base_mask * pwm_mask) OVER (PARTITION BY sample_id, slot) > 0 AND base_mask * pwm_mask > 0
    THEN base_label::DOUBLE ELSE a_base END AS gate FROM cells c)"""
_BCE = "-({y} * ln(1/(1+exp(-({x})))) + (1-{y}) * ln(1 - 1/(1+exp(-({x})))))"


def _bce(x, y):
    return _BCE.format(x=x, y=y)


def _klsum(p):
    z = " + ".join(f"exp({p}{b})" for b in "acgt")
    return "avg(" + " + ".join(f"{b} * (ln({b}) - ({p}{b} - ln({z})))" for b in "acgt") + ")"


_LOSS = f"""tl AS (SELECT sample_id, slot, sum(gate*e_a) AS ga, sum(gate*e_c) AS gc, sum(gate*e_g) AS gg, sum(gate*e_t) AS gt FROM tg GROUP BY ALL),
l1 AS (SELECT sample_id, {_klsum('l')} AS loss_pwm FROM lg JOIN v_spwm USING (sample_id, slot) GROUP BY sample_id),
l2 AS (SELECT sample_id, {_klsum('g')} AS loss_pwm_teacher FROM tl JOIN v_spwm USING (sample_id, slot) GROUP BY sample_id),
l3 AS (SELECT sample_id, sum(base_mask*pwm_mask*({_bce('base_logit', 'base_label')})) / greatest(sum(base_mask*pwm_mask), 1) AS loss_A_base,
    sum(pwm_mask*({_bce('backbone_logit', 'backbone_label')})) / greatest(sum(pwm_mask), 1) AS loss_A_backbone,
    sum(pwm_mask*a_contact) / greatest(sum(pwm_mask), 1) AS loss_sparse,
    sum((1-base_label)*base_mask*pwm_mask*a_base*(abs(e_a)+abs(e_c)+abs(e_g)+abs(e_t))) / greatest(4*sum(base_mask*pwm_mask), 1) AS loss_noncontact
    FROM cells GROUP BY sample_id),
l4 AS (SELECT sample_id, avg({_bce('s', 'site_label')}) AS loss_site FROM (SELECT sample_id, res_idx, max(greatest(base_logit, backbone_logit)) AS s, max(contact_label) AS site_label FROM cells GROUP BY ALL) GROUP BY sample_id),
ls AS (SELECT *, loss_A_base + loss_A_backbone AS loss_A, loss_pwm + loss_pwm_teacher + loss_A_base + loss_A_backbone + 0.5*loss_site + 0.01*loss_sparse + 0.05*loss_noncontact AS loss
    FROM l1 JOIN l2 USING (sample_id) JOIN l3 USING (sample_id) JOIN l4 USING (sample_id))"""
_FOREIGN = f"""fb AS (SELECT sample_id, sequence AS own, aligned AS target, [x::BIGINT FOR x IN string_split({_SLOTS}, ',')] AS s0, off, m FROM sb),
fp AS MATERIALIZED (SELECT sample_id, target, CASE WHEN sample_id % 31 = 6 THEN m + 1 ELSE m END AS m,
    list_transform(s0, lambda s: CASE WHEN s < 0 THEN s ELSE s - off + (CASE WHEN sample_id % 2 = 0 THEN 0 ELSE length(own) END) END) AS slots,
    CASE sample_id % 5 WHEN 0 THEN own WHEN 1 THEN translate(own, 'ACGT', 'TGCA') WHEN 2 THEN reverse(own)
      WHEN 3 THEN reverse(translate(own, 'ACGT', 'TGCA')) ELSE 'GATTACA' || lower(own) END AS sequence FROM fb),
fi AS (SELECT *, CASE WHEN list_min(slots) >= 0 AND list_max(slots) < length(sequence) THEN array_to_string(list_transform(slots, lambda k: substr(sequence, k + 1, 1)), '') END AS raw FROM fp),
fo AS (SELECT *, CASE WHEN raw = target THEN 'direct' WHEN translate(raw, 'ACGT', 'TGCA') = target THEN 'complement' WHEN reverse(raw) = target THEN 'reverse'
    WHEN reverse(translate(raw, 'ACGT', 'TGCA')) = target THEN 'reverse_complement' END AS oi FROM fi),
fw0 AS (SELECT sample_id, unnest([{{'st': strpos(sequence, target) - 1, 'i': 1, 'o': 'direct'}}, {{'st': strpos(sequence, translate(target, 'ACGT', 'TGCA')) - 1, 'i': 2, 'o': 'complement'}},
    {{'st': strpos(sequence, reverse(target)) - 1, 'i': 3, 'o': 'reverse'}}, {{'st': strpos(sequence, reverse(translate(target, 'ACGT', 'TGCA'))) - 1, 'i': 4, 'o': 'reverse_complement'}}]) AS h
    FROM fp WHERE length(target) > 0),
fw AS (SELECT sample_id, min(h.st)::BIGINT AS start, arg_min(h.o, h.st * 10 + h.i) AS ow FROM fw0 WHERE h.st >= 0 GROUP BY sample_id),
fa AS (SELECT fo.*, fw.start, fw.ow FROM fo LEFT JOIN fw USING (sample_id))"""
# The best placement is found once, and only what the alignment needs of it is kept.
_BEST = _SEQBEST.replace("sb AS (SELECT *", "sb AS MATERIALIZED (SELECT sample_id, sequence, aligned, is_full, rev, l, start, m, idxs, off")
FOREIGN = [*TEXT, cand_ctes(), score_ctes("ic_log_likelihood"), _BEST, _FOREIGN]
_MASS = "a_base * (abs(e_a) + abs(e_c) + abs(e_g) + abs(e_t))"
_P4 = ("e_a", "e_c", "e_g", "e_t")
_FULL = ", ".join(f"sum(a_base*{e}) AS f{e[-1]}, coalesce(sum(a_base*{e}) FILTER (WHERE res_idx <> mr), 0) AS k{e[-1]}" for e in _P4)
_ZF = " + ".join(f"exp(f{b})" for b in "acgt")
_ZK = " + ".join(f"exp(k{b})" for b in "acgt")
_SHIFT = " + ".join(f"exp(f{b})/({_ZF}) * ((f{b} - ln({_ZF})) - (k{b} - ln({_ZK})))" for b in "acgt")


def _effect(which, order):
    return f"""SELECT sample_id, slot, '{which}' AS which, mr AS masked_res, round({_SHIFT}, 6) + 0.0::DOUBLE AS kl_shift FROM (
        SELECT sample_id, slot, mr, {_FULL} FROM (SELECT *, first_value(res_idx::BIGINT) OVER (PARTITION BY sample_id, slot ORDER BY a_base {order}, res_idx) AS mr FROM v_pred) GROUP BY sample_id, slot, mr)"""


ORACLES = {
    "ensemble_mean": with_ctes([V.SQL_MODEL], "SELECT sample_id, res_idx::BIGINT AS res_idx, slot, count(DISTINCT model_id) AS n_models, "
        + ", ".join(f"CASE WHEN count(DISTINCT model_id) = 2 THEN round(avg({v}), 12) + 0.0::DOUBLE END AS {v}" for v in ["base_logit", "backbone_logit", *ENERGY])
        + ", CASE WHEN count(DISTINCT model_id) <> 2 THEN 'expected 2 models, got ' || count(DISTINCT model_id) END AS error FROM v_model GROUP BY sample_id, res_idx, slot"),
    "gated_energy_pwm": with_ctes([*PRED, "lg AS (SELECT sample_id, slot, sum(a_base*e_a) AS la, sum(a_base*e_c) AS lc, sum(a_base*e_g) AS lg, sum(a_base*e_t) AS lt FROM v_pred GROUP BY ALL)"],
        f"SELECT sample_id, slot, {_soft()} FROM lg"),
    "contact_site_scores": with_ctes(PRED, """SELECT sample_id, res_idx::BIGINT AS res_idx, round(max(greatest(base_logit, backbone_logit)), 6) AS site_score,
        round(1/(1+exp(-max(greatest(base_logit, backbone_logit)))), 6) AS site_prob FROM v_pred GROUP BY sample_id, res_idx"""),
    "masked_losses": with_ctes([*EVAL_IN, _GATE, _LOSS], "SELECT sample_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in LOSSES) + " FROM ls"),
    "teacher_gate_pwm": with_ctes([*EVAL_IN, _GATE, "tl AS (SELECT sample_id, slot, sum(gate*e_a) AS ga, sum(gate*e_c) AS gc, sum(gate*e_g) AS gg, sum(gate*e_t) AS gt FROM tg GROUP BY ALL)"],
        f"SELECT sample_id, slot, {_soft('g')} FROM tl"),
    "epoch_metrics": "SELECT dayofyear(ts) AS epoch, round(avg(value), 6) AS loss, round(avg(value*2), 6) AS loss_pwm FROM events GROUP BY ALL",
    "best_epoch": "SELECT epoch, round(loss, 6) AS loss FROM (SELECT dayofyear(ts) AS epoch, avg(value) AS loss FROM events GROUP BY ALL) ORDER BY loss, epoch LIMIT 1",
    "align_by_slot_index": with_ctes(FOREIGN, "SELECT sample_id, oi AS orientation FROM fo"),
    "align_by_window": with_ctes(FOREIGN, "SELECT sample_id, start, ow AS orientation FROM fa"),
    "align_predictions": with_ctes(FOREIGN, """SELECT sample_id, CASE WHEN length(target) <> m THEN NULL WHEN oi IS NOT NULL THEN 'slot_index_' || oi WHEN ow IS NOT NULL THEN 'window_' || ow || ':' || start END AS mode,
        CASE WHEN length(target) <> m THEN 'alignment_sequence length ' || length(target) || ' != PWM length ' || m
             WHEN oi IS NULL AND ow IS NULL THEN 'could not align predicted sequence: target=' || target || ' sequence=' || sequence || ' M=' || m || ' idx=[' || array_to_string(slots, ', ') || ']' END AS error,
        array_to_string([k + CASE WHEN cp THEN 0.75::DOUBLE ELSE 0::DOUBLE END FOR k IN ks], ',') AS matrix_a,
        array_to_string([k + CASE WHEN cp THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END FOR k IN ks], ',') AS matrix_g
        FROM (SELECT *, coalesce(oi, ow) IN ('complement', 'reverse_complement') AS cp,
          CASE WHEN length(target) <> m OR coalesce(oi, ow) IS NULL THEN NULL WHEN coalesce(oi, ow) IN ('reverse', 'reverse_complement') THEN list_reverse(used) ELSE used END AS ks
          FROM (SELECT *, CASE WHEN oi IS NOT NULL THEN slots ELSE range(start, start + length(target)) END AS used FROM fa))"""),
    "top_contact_pairs": with_ctes(EVAL_IN, """SELECT sample_id, res_idx::BIGINT AS res_idx, slot, round(a_base, 6) AS a_base, base_label::BIGINT AS base_label
        FROM cells QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY a_base DESC, res_idx, slot) <= 5"""),
    "column_contribution": with_ctes(PRED, f"SELECT sample_id, res_idx::BIGINT AS res_idx, slot, round({_MASS} / nullif(sum({_MASS}) OVER (PARTITION BY sample_id, slot), 0), 6) AS share FROM v_pred"),
    "mask_residue_effect": with_ctes(PRED, _effect("top", "DESC") + " UNION ALL " + _effect("lowest", "ASC")),
}
