"""Contact labels between protein residues and DNA residues or motif slots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.constants import BACKBONE_CUTOFF, BASE_CUTOFF
from helixframe.operators.geometry import group_distances, near_pairs, point_groups
from helixframe.operators.ordering import dense_index

AXES = ("x", "y", "z")


def chain_positions(selected_dna: DataFrame) -> DataFrame:
    """structure_id, chain, pos (within the chain), dna_idx, residue_id, letter."""
    from helixframe.operators.structure import one_letter, residue_id

    return dense_index(
        selected_dna.select("structure_id", "chain", "sel_idx", residue_id().alias("residue_id"),
                            one_letter().alias("letter")),
        ["structure_id", "chain"], "sel_idx", "pos",
    ).withColumnRenamed("sel_idx", "dna_idx")


def _indexed_atoms(tagged: DataFrame, selected: DataFrame, index: str) -> DataFrame:
    sel = selected.select("structure_id", "res_ord", F.col("sel_idx").alias(index))
    return tagged.join(sel, ["structure_id", "res_ord"])


def residue_distances(
    tagged: DataFrame, protein: DataFrame, dna: DataFrame, max_cutoff: float = BACKBONE_CUTOFF,
    of_protein: Sequence[str] = (), of_dna: Sequence[str] = (),
) -> DataFrame:
    """structure_id, res_idx, dna_idx, base_dist, backbone_dist: minimum heavy-atom
    distances up to ``max_cutoff`` (NULL beyond).  The DNA side, the smaller one,
    is copied to the neighbouring cells.

    ``of_protein``, ``of_dna``: columns of the residues that the pairs keep.  They and the indices are joined to the
    residues; close pairs of a dense structure can be many more.  ``res_ord``: whatever names a residue in its structure."""
    p = protein.select("structure_id", "res_ord", F.col("sel_idx").alias("res_idx"), *of_protein)
    d = dna.select("structure_id", "res_ord", F.col("sel_idx").alias("dna_idx"), *of_dna)
    key = ["structure_id", "res_ord"]
    p_groups = point_groups(tagged.where("kind = 'protein'"), ["res_ord"]).join(p, key)
    base = F.when(F.col("part") == "base", 0).when(F.col("part") == "backbone", 1)
    d_groups = point_groups(tagged.where("kind = 'dna'"), ["res_ord"], base).join(d, key)
    near = group_distances(p_groups, d_groups, max_cutoff, ["res_idx", *of_protein], ["dna_idx", *of_dna], parts=2)
    return near.withColumns({"d0": F.sqrt("d0"), "d1": F.sqrt("d1")}).withColumnsRenamed({"d0": "base_dist", "d1": "backbone_dist"})


def contact_labels(
    distances: DataFrame, base_cutoff: float = BASE_CUTOFF, backbone_cutoff: float = BACKBONE_CUTOFF
) -> DataFrame:
    """Sparse labels per (residue, DNA residue); cutoffs are inclusive."""
    base = F.coalesce(F.col("base_dist") <= base_cutoff, F.lit(False)).cast("int")
    backbone = F.coalesce(F.col("backbone_dist") <= backbone_cutoff, F.lit(False)).cast("int")
    more = [c for c in distances.columns if c not in ("structure_id", "res_idx", "dna_idx", "base_dist", "backbone_dist")]
    return distances.select(
        "structure_id", "res_idx", "dna_idx", base.alias("base_label"), backbone.alias("backbone_label"), *more,
    ).where((F.col("base_label") == 1) | (F.col("backbone_label") == 1))


def missing_parts(tagged: DataFrame, dna: DataFrame) -> DataFrame:
    """DNA residues without base or backbone atoms: structure_id, dna_idx, part."""
    have = tagged.where("kind = 'dna'").groupBy("structure_id", "res_ord").agg(
        F.count_if(F.col("part") == "base").alias("nb"), F.count_if(F.col("part") == "backbone").alias("nk"))
    j = dna.select("structure_id", "res_ord", F.col("sel_idx").alias("dna_idx")).join(
        have, ["structure_id", "res_ord"], "left")
    lost = F.array_compact(F.array(
        F.when(F.coalesce("nb", F.lit(0)) == 0, "base"), F.when(F.coalesce("nk", F.lit(0)) == 0, "backbone")))
    return j.select("structure_id", "dna_idx", F.explode(lost).alias("part"))


def slot_rows(placements: DataFrame) -> DataFrame:
    """sample_id, structure_id, slot, dna_idx (-1 = not visible) from placements
    with ``slot_to_dna_index``."""
    return placements.select(
        "sample_id", "structure_id", F.posexplode("slot_to_dna_index").alias("slot", "dna_idx"))


def pwm_mask() -> Column:
    return F.when(F.col("dna_idx") >= 0, 1).otherwise(0)


def dense_labels(
    slots: DataFrame, protein: DataFrame, contacts: DataFrame, missing: DataFrame
) -> DataFrame:
    """The N x M frame of every sample, for a consumer that wants each cell.

    Nothing here stores it: ``slot_labels`` holds the same in a row per slot.
    """
    no_base = missing.where("part = 'base'").select("structure_id", "dna_idx", F.lit(1).alias("no_base"))
    s = slots.withColumn("pwm_mask", pwm_mask()).join(no_base, ["structure_id", "dna_idx"], "left")
    frame = s.join(protein.select("structure_id", F.col("sel_idx").alias("res_idx")), "structure_id")
    j = frame.join(contacts, ["structure_id", "res_idx", "dna_idx"], "left")
    base = F.coalesce("base_label", F.lit(0))
    backbone = F.coalesce("backbone_label", F.lit(0))
    return j.select(
        "sample_id", "res_idx", "slot", "dna_idx", "pwm_mask",
        F.when((F.col("pwm_mask") == 1) & F.col("no_base").isNull(), 1).otherwise(0).alias("base_mask"),
        base.alias("base_label"), backbone.alias("backbone_label"), contact_union(base, backbone).alias("contact_label"))


def slot_labels(slots: DataFrame, contacts: DataFrame, missing: DataFrame) -> DataFrame:
    """The stored form of the labels: a row for each slot with its masks and the sorted
    residues in base and in backbone contact; every other cell of the slot is 0.  The lists
    are made once for a nucleotide, whatever samples have it in a slot."""
    no_base = missing.where("part = 'base'").select("structure_id", "dna_idx").distinct().withColumn("no_base", F.lit(1))
    used = slots.select("structure_id", "dna_idx").distinct()
    hit = contacts.join(used, ["structure_id", "dna_idx"], "left_semi")
    of = lambda label: F.array_sort(F.collect_list(F.when(F.col(label) == 1, F.col("res_idx"))))
    lists = hit.groupBy("structure_id", "dna_idx").agg(of("base_label").alias("base_res"), of("backbone_label").alias("backbone_res"))
    s = slots.withColumn("pwm_mask", pwm_mask()).join(no_base, ["structure_id", "dna_idx"], "left").join(lists, ["structure_id", "dna_idx"], "left")
    none = F.array().cast("array<int>")
    return s.select(
        "sample_id", "structure_id", "slot", "dna_idx", "pwm_mask",
        F.when((F.col("pwm_mask") == 1) & F.col("no_base").isNull(), 1).otherwise(0).alias("base_mask"),
        *[F.coalesce(F.col(c).cast("array<int>"), none).alias(c) for c in ("base_res", "backbone_res")])


def sparse_labels(slots: DataFrame, contacts: DataFrame) -> DataFrame:
    """Only the cells in contact: enough for counting, without the N x M frame."""
    return slots.join(contacts, ["structure_id", "dna_idx"]).select(
        "sample_id", "res_idx", "slot", "dna_idx", "base_label", "backbone_label",
        F.greatest("base_label", "backbone_label").alias("contact_label"))


def contact_union(base: Column, backbone: Column) -> Column:
    return F.greatest(base, backbone)


def site_labels(labels: DataFrame) -> DataFrame:
    return labels.groupBy("sample_id", "res_idx").agg(F.max("contact_label").alias("site_label"))


def contact_counts(labels: DataFrame) -> DataFrame:
    """Positives per sample; residues are summed first so that one large sample
    is reduced on the map side."""
    per_res = labels.groupBy("sample_id", "res_idx").agg(
        F.sum("base_label").alias("b"), F.sum("backbone_label").alias("k"), F.sum("contact_label").alias("c"))
    return per_res.groupBy("sample_id").agg(
        F.sum("b").alias("A_base_pos"), F.sum("k").alias("A_backbone_pos"),
        F.sum("c").alias("A_contact_pos"), F.count_if(F.col("c") > 0).alias("site_pos"))


def once_per_placement(slots: DataFrame, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``count`` (slots -> rows with sample_id) for one of all samples that have the same nucleotides in their slots, given
    to each of them."""
    seen = slots.where("dna_idx >= 0").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("structure_id", "dna_idx"))).alias("_seen"))
    first = seen.groupBy("_seen").agg(F.min("sample_id").alias("_first"))
    one = slots.join(first.select(F.col("_first").alias("sample_id")), "sample_id", "left_semi")
    return seen.join(first, "_seen").drop("_seen").join(count(one).withColumnRenamed("sample_id", "_first"), "_first").drop("_first")


def passes(min_base: int = 0, min_contact: int = 1, min_site: int = 1) -> Column:
    return ((F.col("A_contact_pos") >= min_contact) & (F.col("site_pos") >= min_site)
            & (F.col("A_base_pos") >= min_base))


def label_filter(counts: DataFrame, min_base: int = 0, min_contact: int = 1, min_site: int = 1) -> DataFrame:
    """Routes rows: adds ``passes`` instead of dropping."""
    return counts.withColumn("passes", passes(min_base, min_contact, min_site))


def cutoff_sweep(
    slots: DataFrame, distances: DataFrame, base_cutoffs: list[float], backbone_cutoffs: list[float]
) -> DataFrame:
    """Label counts per sample for every pair of cutoffs, from distances computed
    once at the largest one."""
    settings = F.array(*[
        F.struct(F.lit(b).alias("base_cutoff"), F.lit(k).alias("backbone_cutoff"))
        for b in base_cutoffs for k in backbone_cutoffs])
    counted = once_per_placement(slots, lambda one: _sweep_counts(one, distances, settings))
    every = slots.select("sample_id").distinct().withColumn("s", F.explode(settings)).select("sample_id", "s.*")
    return every.join(counted, ["sample_id", "base_cutoff", "backbone_cutoff"], "left").fillna(0)


def _sweep_counts(slots: DataFrame, distances: DataFrame, settings: Column) -> DataFrame:
    hit = slots.join(distances, ["structure_id", "dna_idx"]).withColumn("s", F.explode(settings)).select(
        "sample_id", "res_idx", "s.*",
        F.coalesce(F.col("base_dist") <= F.col("s.base_cutoff"), F.lit(False)).cast("int").alias("b"),
        F.coalesce(F.col("backbone_dist") <= F.col("s.backbone_cutoff"), F.lit(False)).cast("int").alias("k"))
    keys = ["sample_id", "base_cutoff", "backbone_cutoff"]
    per_res = hit.groupBy(*keys, "res_idx").agg(
        F.sum("b").alias("b"), F.sum("k").alias("k"), F.sum(F.greatest("b", "k")).alias("c"))
    return per_res.groupBy(*keys).agg(
        F.sum("b").alias("A_base_pos"), F.sum("k").alias("A_backbone_pos"),
        F.sum("c").alias("A_contact_pos"), F.count_if(F.col("c") > 0).alias("site_pos"))


def slot_centers(slots: DataFrame, tagged: DataFrame, dna: DataFrame) -> DataFrame:
    """Per slot: centroid of base and of backbone atoms, and whether it is visible."""
    used = slots.select("structure_id", F.col("dna_idx").alias("sel_idx")).distinct()
    atoms = _indexed_atoms(tagged, dna.join(used, ["structure_id", "sel_idx"], "left_semi"), "dna_idx")
    cents = atoms.groupBy("structure_id", "dna_idx").agg(*[
        F.avg(F.when(F.col("part") == part, F.col(a))).alias(f"{part}_{a}")
        for part in ("base", "backbone") for a in AXES])
    return slots.join(cents, ["structure_id", "dna_idx"], "left").withColumn("visible", F.col("dna_idx") >= 0)


#: Slots of a row, and parts of the residues, that meet in ``residue_slot_geometry``.
SLOT_BLOCK, RESIDUE_PARTS = 512, 16


def residue_slot_geometry(centers: DataFrame, points: DataFrame, cutoff: float, finish: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Distance and unit direction from residue points to base centres within ``cutoff``; ``finish`` is put on each.

    A nucleotide is paired with residues once, whatever samples have it in a slot, and values are made once for a pair.  Slots
    travel in blocks beside the pairs of their nucleotide, by part of the residues, and become rows where they meet: the result
    grows with slots times residues in reach, and nothing of it is shuffled.  A block is given out whole for each residue, so that
    files hold the same run of samples again and again, which packs well.  Both sides are dealt to all shuffle partitions:
    they are small, the result is not, and by their size they would be put together."""
    place = ["structure_id", "dna_idx"]
    seen = centers.where(F.col("base_x").isNotNull())
    bases = seen.select(*place, *[F.col(f"base_{a}").alias(a) for a in AXES]).distinct()
    near = near_pairs(points.select("structure_id", "res_idx", *AXES), bases, cutoff).withColumn("dist", F.sqrt("d2")).where(F.col("dist") <= cutoff)
    directions = [finish(F.try_divide(F.col(f"q_{a}") - F.col(f"p_{a}"), F.col("dist"))).alias(f"dir_{a}") for a in AXES]
    part = F.pmod(F.xxhash64("res_idx"), F.lit(RESIDUE_PARTS)).cast("int").alias("_part")
    pairs = near.select(*place, part, "res_idx", finish(F.col("dist")).alias("dist"), *directions)
    number = seen.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / SLOT_BLOCK).cast("bigint").alias("_n"))
    blocks = centers.select(*place, "sample_id", "slot").join(number, place).groupBy(
        *place, F.pmod(F.xxhash64("sample_id", "slot"), "_n").alias("_block")).agg(F.collect_list(F.struct("sample_id", "slot")).alias("_slots"))
    blocks = blocks.select(*place, F.explode(F.sequence(F.lit(0), F.lit(RESIDUE_PARTS - 1))).alias("_part"), "_slots")
    n, key = int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*place, "_part"]
    met = blocks.repartition(n, *key).hint("merge").join(pairs.repartition(n, *key), key)
    return met.withColumn("_slot", F.explode("_slots")).select(
        F.col("_slot.sample_id").alias("sample_id"), "res_idx", F.col("_slot.slot").alias("slot"), "dist", *[f"dir_{a}" for a in AXES])


def slot_center_rmsd(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Root mean square distance of slot centres per sample.
    Both: sample_id, slot, x, y, z."""
    t = truth.select("sample_id", "slot", *[F.col(a).alias(f"t_{a}") for a in AXES])
    d2 = sum((F.col(a) - F.col(f"t_{a}")) * (F.col(a) - F.col(f"t_{a}")) for a in AXES)
    return predicted.join(t, ["sample_id", "slot"]).groupBy("sample_id").agg(
        F.sqrt(F.avg(d2)).alias("rmsd"), F.count(F.lit(1)).alias("n_slots"))
