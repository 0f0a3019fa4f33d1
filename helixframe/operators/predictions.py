"""Relational parts of prediction tables: ensembles, energies, losses, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.pwm import ACGT, bce_with_logits, log_softmax, normalized, sigmoid, softmax, total
from helixframe.functions.strict import refuse
from helixframe.operators import structure as S
from helixframe.operators.ordering import first_per_key

ENERGY = tuple(f"e_{b}" for b in ACGT)


def ensemble_mean(rows: DataFrame, keys: Sequence[str], values: Sequence[str], expected: int | None = None) -> DataFrame:
    """Elementwise mean over the models, one row each for every key.

    With ``expected`` a key with another number of rows has no mean: its values are NULL
    and ``error`` says why."""
    got = rows.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_models"))
    if expected is None:
        return got.withColumn("error", F.lit(None).cast("string"))
    whole = F.col("n_models") == expected
    return got.select(*keys, *[F.when(whole, F.col(v)).alias(v) for v in values], "n_models", F.when(
        ~whole, F.concat(F.lit(f"expected {expected} models, got "), F.col("n_models").cast("string"))).alias("error"))


def gated_energy_logits(cells: DataFrame, gate: str = "a_base") -> DataFrame:
    """logits per (sample, slot): sum over residues of gate * energy."""
    return cells.groupBy("sample_id", "slot").agg(
        *[F.sum(F.col(gate) * F.col(e)).alias(f"l_{b}") for b, e in zip(ACGT, ENERGY)])


def gated_energy_pwm(cells: DataFrame, gate: str = "a_base") -> DataFrame:
    logits = gated_energy_logits(cells, gate)
    p = softmax([F.col(f"l_{b}") for b in ACGT])
    return logits.select("sample_id", "slot", *[c.alias(f"p_{b}") for b, c in zip(ACGT, p)])


def contact_scores(cells: DataFrame) -> DataFrame:
    """Add a_base, a_backbone, a_contact and the contact logit."""
    logit = F.greatest("base_logit", "backbone_logit")
    return (
        cells.withColumn("a_base", sigmoid(F.col("base_logit")))
        .withColumn("a_backbone", sigmoid(F.col("backbone_logit")))
        .withColumn("contact_logit", logit)
        .withColumn("a_contact", F.greatest("a_base", "a_backbone"))
    )


def site_scores(scored: DataFrame) -> DataFrame:
    per = scored.groupBy("sample_id", "res_idx").agg(F.max("contact_logit").alias("site_score"))
    return per.withColumn("site_prob", sigmoid(F.col("site_score")))


def teacher_gate(cells: DataFrame) -> DataFrame:
    """``gate``: the label where the slot has an observed positive and the cell is
    observed, the model's a_base elsewhere.  ``cells``: base_label, base_mask (already
    combined with the slot mask), a_base."""
    slots = cells.groupBy("sample_id", "slot").agg(
        F.max(F.col("base_label") * F.col("base_mask")).alias("_pos"))
    gate = F.when((F.col("_pos") > 0) & (F.col("base_mask") > 0), F.col("base_label").cast("double")).otherwise(F.col("a_base"))
    return cells.join(slots, ["sample_id", "slot"]).withColumn("gate", gate).drop("_pos")


def teacher_gate_pwm(cells: DataFrame) -> DataFrame:
    return gated_energy_pwm(teacher_gate(cells), "gate")


def _kl_loss(logits: DataFrame, target: DataFrame, out: str) -> DataFrame:
    """Sum over slots of KL(target || softmax(logits)) / number of slots."""
    lp = log_softmax([F.col(f"l_{b}") for b in ACGT])
    t = normalized([F.col(b) for b in ACGT])
    row = total([x * (F.ln(x) - y) for x, y in zip(t, lp)])
    return logits.join(target, ["sample_id", "slot"]).groupBy("sample_id").agg(F.avg(row).alias(out))


DEFAULT_WEIGHTS = {"pwm_teacher": 1.0, "A_base": 1.0, "A_backbone": 1.0, "site": 0.5, "sparse": 0.01, "noncontact": 0.05}


def masked_losses(cells: DataFrame, target: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All loss terms per sample.

    ``cells``: sample_id, res_idx, slot, base_label, backbone_label, contact_label,
    base_mask, pwm_mask, base_logit, backbone_logit, energies; ``target``: sample_id,
    slot, a, c, g, t.
    """
    w = {**DEFAULT_WEIGHTS, **(weights or {})}
    c = contact_scores(cells).withColumn("base_mask", F.col("base_mask") * F.col("pwm_mask"))
    d = lambda n: F.col(n).cast("double")
    mean = lambda value, mask, k=1: F.sum(value * mask) / F.greatest(F.sum(mask) * k, F.lit(1.0))
    energy = total([F.abs(F.col("a_base") * F.col(e)) for e in ENERGY])
    per = c.groupBy("sample_id").agg(
        mean(bce_with_logits(F.col("base_logit"), d("base_label")), d("base_mask")).alias("loss_A_base"),
        mean(bce_with_logits(F.col("backbone_logit"), d("backbone_label")), d("pwm_mask")).alias("loss_A_backbone"),
        mean(F.col("a_contact"), d("pwm_mask")).alias("loss_sparse"),
        mean((1.0 - d("base_label")) * energy, d("base_mask"), 4).alias("loss_noncontact"))
    site = c.groupBy("sample_id", "res_idx").agg(
        F.max("contact_logit").alias("s"), F.max("contact_label").cast("double").alias("y")
    ).groupBy("sample_id").agg(F.avg(bce_with_logits(F.col("s"), F.col("y"))).alias("loss_site"))
    plain = _kl_loss(gated_energy_logits(c), target, "loss_pwm")
    teacher = _kl_loss(gated_energy_logits(teacher_gate(c), "gate"), target, "loss_pwm_teacher")
    j = per.join(site, "sample_id").join(plain, "sample_id").join(teacher, "sample_id")
    loss = (F.col("loss_pwm") + w["pwm_teacher"] * F.col("loss_pwm_teacher") + w["A_base"] * F.col("loss_A_base")
            + w["A_backbone"] * F.col("loss_A_backbone") + w["site"] * F.col("loss_site")
            + w["sparse"] * F.col("loss_sparse") + w["noncontact"] * F.col("loss_noncontact"))
    return j.withColumn("loss_A", F.col("loss_A_base") + F.col("loss_A_backbone")).withColumn("loss", loss)


def epoch_metrics(rows: DataFrame, values: Sequence[str]) -> DataFrame:
    return rows.groupBy("epoch").agg(*[F.avg(v).alias(v) for v in values])


def best_epoch(epochs: DataFrame, value: str = "loss") -> DataFrame:
    """Earliest epoch with the smallest value."""
    return epochs.agg(F.min_by("epoch", F.struct(value, "epoch")).alias("epoch"), F.min(value).alias(value))


# -------------------------------------------------- aligning foreign predictions
# Orientations in the order they are tried: name, SQL of the text.
ORIENTATIONS = (
    ("direct", "{raw}"),
    ("complement", "translate({raw}, 'ACGT', 'TGCA')"),
    ("reverse", "reverse({raw})"),
    ("reverse_complement", "reverse(translate({raw}, 'ACGT', 'TGCA'))"),
)


def _first_match(raw: str) -> str:
    """1-based number of the first orientation of ``raw`` equal to the target."""
    cases = " ".join(f"WHEN {sql.format(raw=raw)} = target THEN {i}" for i, (_, sql) in enumerate(ORIENTATIONS, 1))
    return f"CASE {cases} END"


def _name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n, _ in ORIENTATIONS]), number - 1)


def align_by_slot_index(preds: DataFrame) -> DataFrame:
    """``preds``: sequence, target, slots ARRAY -> ``by_index`` (orientation number,
    NULL when a slot is out of range or no orientation matches)."""
    inside = F.expr("forall(slots, k -> k >= 0 and k < length(sequence))")
    raw = F.expr("array_join(transform(slots, k -> substring(sequence, cast(k + 1 as int), 1)), '')")
    return preds.withColumn("_raw", F.when(inside, raw)).withColumn("by_index", F.expr(_first_match("_raw"))).drop("_raw")


def align_by_window(preds: DataFrame) -> DataFrame:
    """Per sample the first start whose window matches in some orientation.

    Each of the four oriented targets is searched as a substring (``locate``), which
    runs in the sequence's own row; the smallest start wins, then the order of
    orientations.
    """
    found = F.array(*[
        F.expr(f"named_struct('start', locate({sql.format(raw='target')}, sequence) - 1, 'orient', {i})")
        for i, (_, sql) in enumerate(ORIENTATIONS, 1)])
    hits = F.filter(found, lambda h: h.getField("start") >= 0)
    best = F.when((F.length("target") > 0) & (F.length("sequence") >= F.length("target")), F.array_min(hits))
    return preds.withColumn("by_window", best)


def align_predictions(preds: DataFrame, strict: bool = False) -> DataFrame:
    """Index mode, else window mode, else an error.  ``strict``: any error fails the call, with their number.

    ``preds``: sample_id, sequence, target, slots, m -> mode, error; with ``rows`` (a
    foreign matrix, ARRAY<STRUCT<a,c,g,t>>, one row per letter of the sequence) also
    ``matrix``, the rows at the slots or in the window, turned as the letters were.
    """
    d = align_by_window(align_by_slot_index(preds))
    fits = F.length("target") == F.col("m")
    mode = F.when(F.col("by_index").isNotNull(), F.concat(F.lit("slot_index_"), _name(F.col("by_index")))).when(
        F.col("by_window").isNotNull(),
        F.concat(F.lit("window_"), _name(F.col("by_window.orient")), F.lit(":"), F.col("by_window.start").cast("string")))
    idx = F.concat(F.lit("["), F.array_join(F.col("slots").cast("array<string>"), ", "), F.lit("]"))
    error = F.when(~fits, F.concat(
        F.lit("alignment_sequence length "), F.length("target").cast("string"), F.lit(" != PWM length "), F.col("m").cast("string"))
    ).when(mode.isNull(), F.concat(
        F.lit("could not align predicted sequence: target="), "target", F.lit(" sequence="), "sequence",
        F.lit(" M="), F.col("m").cast("string"), F.lit(" idx="), idx))
    out = d.withColumn("mode", F.when(fits, mode)).withColumn("error", error)
    if strict:
        out = refuse(out, F.col("error"), "predictions that cannot be aligned")
    if "rows" not in preds.columns:
        return out
    first = F.col("by_window.start").cast("bigint")
    window = F.when(first.isNotNull(), F.sequence(first, first + F.length("target") - 1))
    used = F.when(F.col("by_index").isNotNull(), F.col("slots").cast("array<bigint>")).otherwise(window)
    turned = reorder_matrix(F.col("rows"), used, F.coalesce("by_index", "by_window.orient"))
    return out.withColumn("matrix", F.when(F.col("mode").isNotNull(), turned))


def reorder_matrix(rows: Column, slots: Column, orient: Column) -> Column:
    """Pick matrix rows (ARRAY<STRUCT<a,c,g,t>>) by slot and orient them."""
    picked = F.transform(slots, lambda k: F.get(rows, k.cast("int")))
    swap = lambda arr: F.transform(arr, lambda r: F.struct(
        r["t"].alias("a"), r["g"].alias("c"), r["c"].alias("g"), r["a"].alias("t")))
    return (F.when(orient == 1, picked).when(orient == 2, swap(picked))
            .when(orient == 3, F.reverse(picked)).when(orient == 4, F.reverse(swap(picked))))


# ------------------------------------------------------------------ inspection
def top_contact_pairs(cells: DataFrame, score: str, k: int = 5) -> DataFrame:
    """The k highest cells of each sample; ties by residue, then slot."""
    return first_per_key(cells, ["sample_id"], [F.col(score).desc(), F.col("res_idx"), F.col("slot")], k)


def pair_distances(pairs: DataFrame, slots: DataFrame, protein: DataFrame, dna: DataFrame, atoms: DataFrame) -> DataFrame:
    """Chosen residue-slot pairs with ``base_dist`` and ``backbone_dist``: the least distance of the residue's heavy atoms
    to those of the slot's base and of its backbone, however far.  NULL for a slot without a nucleotide or without such atoms.

    ``pairs``: sample_id, res_idx, slot; ``slots``: sample_id, structure_id, slot, dna_idx; ``protein``, ``dna``: indexed
    residues.  Only the atoms of the residues named are joined, each once for all samples on its structure."""
    at = pairs.join(slots.select("sample_id", "structure_id", "slot", "dna_idx"), ["sample_id", "slot"], "left")
    wanted = at.where("dna_idx >= 0").select("structure_id", F.col("res_idx").cast("bigint").alias("res_idx"), F.col("dna_idx").cast("bigint").alias("dna_idx")).distinct()
    heavy = S.keyed_atoms(atoms)
    key = F.struct(*S.RESIDUE_KEY[1:]).alias("res_ord")

    def of(side: DataFrame, name: str, prefix: str, *more: str) -> DataFrame:
        named = side.select("structure_id", key, F.col("sel_idx").cast("bigint").alias(name))
        used = named.join(wanted.select("structure_id", name).distinct(), ["structure_id", name], "left_semi")
        return heavy.join(used, ["structure_id", "res_ord"]).select("structure_id", name, *more, *[F.col(a).alias(f"{prefix}_{a}") for a in "xyz"])

    near = wanted.join(of(protein, "res_idx", "p"), ["structure_id", "res_idx"]).join(of(dna, "dna_idx", "q", "part"), ["structure_id", "dna_idx"])
    d2 = sum((F.col(f"p_{a}") - F.col(f"q_{a}")) * (F.col(f"p_{a}") - F.col(f"q_{a}")) for a in "xyz")
    least = near.groupBy("structure_id", "res_idx", "dna_idx").agg(*[
        F.sqrt(F.min(F.when(F.col("part") == part, d2))).alias(f"{part}_dist") for part in ("base", "backbone")])
    return at.join(least, ["structure_id", "res_idx", "dna_idx"], "left")


def column_contribution(cells: DataFrame) -> DataFrame:
    """Share of each residue in the absolute gated energy of its slot."""
    mass = F.col("a_base") * total([F.abs(F.col(e)) for e in ENERGY])
    c = cells.withColumn("mass", mass)
    sums = c.groupBy("sample_id", "slot").agg(F.sum("mass").alias("_all"))
    return c.join(sums, ["sample_id", "slot"]).withColumn("share", F.try_divide("mass", "_all")).drop("_all")


def mask_residue_effect(cells: DataFrame, which: Sequence[str] = ("top", "lowest")) -> DataFrame:
    """KL shift of each motif column, KL(full || masked), when its strongest
    (``top``) or weakest (``lowest``) residue is left out; ties: smaller res_idx."""
    orders = {"top": F.struct("a_base", -F.col("res_idx")), "lowest": F.struct(-F.col("a_base"), -F.col("res_idx"))}
    gated = [F.col("a_base") * F.col(e) for e in ENERGY]
    # The masked sums are the full ones minus one residue, so a single pass does.
    picks = [F.max_by(F.struct("res_idx", *[g.alias(f"m_{b}") for b, g in zip(ACGT, gated)]), orders[w]).alias(w) for w in which]
    sums = cells.groupBy("sample_id", "slot").agg(*[F.sum(g).alias(f"f_{b}") for b, g in zip(ACGT, gated)], *picks)
    long = sums.withColumn("p", F.explode(F.array(*[
        F.struct(F.lit(w).alias("which"), F.col(w).alias("v")) for w in which])))
    full = [F.col(f"f_{b}") for b in ACGT]
    kept = [F.col(f"f_{b}") - F.col(f"p.v.m_{b}") for b in ACGT]
    shift = total([p * (x - y) for p, x, y in zip(softmax(full), log_softmax(full), log_softmax(kept))])
    return long.select("sample_id", "slot", "p.which", F.col("p.v.res_idx").alias("masked_res"), shift.alias("kl_shift"))
