"""Many samples on one dense structure: what grows with samples times windows, edges or contacts is never written."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import align as A
from helixframe.operators import contacts as C
from helixframe.operators import geometry as G
from helixframe.operators import prepare
from helixframe.operators import structure as S
from helixframe.plans import q_align
from helixframe.sources import store
from tests.builders import consensus_matrix, motif_rows, toy_complex


def test_group_distances_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = {}
    for side, n in (("a", 150), ("b", 170)):
        rows[side] = []
        for g in range(n):
            key, middle, wide = f"s{g % 2}", rng.uniform(-20, 20, 3), 40 if g == 7 else 3
            for _ in range(int(rng.integers(1, 6))):
                rows[side].append((key, g, *map(float, middle + rng.normal(0, wide, 3)), ["base", "backbone"][int(rng.integers(2))]))
        rows[side].append(("s0", 999, None, 0.0, 0.0, "base"))
    for side in "ab":  # on the borders of cells, exactly at the cutoff
        rows[side] += [("s0", 500, 15.0 if side == "a" else 20.0, 0.0, 0.0, "base"), ("alone" + side, 1, 0.0, 0.0, 0.0, "base")]
    frames = {k: spark.createDataFrame(v, f"structure_id string, {k}_id int, x double, y double, z double, part string") for k, v in rows.items()}
    part = F.when(F.col("part") == "base", 0).otherwise(1)
    pairs = G.group_distances(G.point_groups(frames["a"], ["a_id"]), G.point_groups(frames["b"], ["b_id"], part), 5.0, ["a_id"], ["b_id"], parts=2)
    got = {(r.structure_id, r.a_id, r.b_id): (r.d0, r.d1) for r in pairs.collect()}
    want = {}
    for k, i, x, y, z, _ in rows["a"]:
        for q, j, u, v, w, kind in rows["b"]:
            if k == q and None not in (x, u):
                d = (x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w)
                if d <= 25:
                    held = want.setdefault((k, i, j), [None, None])
                    at = int(kind != "base")
                    held[at] = d if held[at] is None else min(held[at], d)
    assert got == {k: tuple(v) for k, v in want.items()} and ("s0", 500, 500) in got and pairs.count() == len(want) > 300


def test_close_pairs_are_not_shuffled(spark):
    kinds = "structure_id string, {}_id int, x double, y double, z double"
    a, b = (spark.createDataFrame([("s", k, float(k), 0.0, 0.0) for k in range(20)], kinds.format(c)) for c in "ab")
    plan = G.min_group_distance(a, b, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")]


def test_candidates_write_no_row_for_a_contact(spark, monkeypatch):
    written = []
    for module in (q_align, A):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: (written.append(df.columns), cut(df))[1])
    assert q_align.align_contact_constrained(spark, "/root/testdata/sf0.001").count() == 1000
    assert not [c for c in written if "base_dist" in c or "base_label" in c]


def _batch(spark, n):
    atoms = toy_complex(spark, "TTACGTAA", 3)
    kinds = "sample_id long, structure_id string, motif_id long, protein_chains string, dna_chains string"
    samples = spark.createDataFrame([(k, "s", 7, "", "") for k in range(n)], kinds)
    return samples, atoms, motif_rows(spark, 7, consensus_matrix("ACGT"))


def test_batch_makes_no_row_for_a_candidate(spark, monkeypatch):
    monkeypatch.setattr(A, "score_candidates", lambda *a: pytest.fail("a row for each candidate"))
    samples, atoms, motifs = _batch(spark, 300)
    got = prepare.prepare_samples(samples, atoms, motifs, min_contact=0, min_site=0).collect()
    assert len(got) == 300 and {(r.error, r.alignment_start, r.alignment_candidate_count) for r in got} == {(None, 2, 10)}


def test_samples_of_a_selection_store_its_arrays_once(spark, tmp_path):
    samples, atoms, motifs = _batch(spark, 40)
    root = str(tmp_path / "out")
    prepare.prepare_manifest(samples, atoms, motifs, root, min_contact=0, min_site=0)
    assert "edges" not in spark.read.parquet(f"{root}/processed").columns
    assert spark.read.parquet(f"{root}/shared").count() == 1
    back = store.read_samples(spark, root)
    assert {(len(r.residues), len(r.edges), len(r.slots)) for r in back.collect()} == {(1, 0, 4)}
    assert store.read_samples(spark, root, ["edges"]).columns == ["sample_id", "run", "processed_path", "edges"]
    # A run whose rows have arrays of their own lies beside the others.
    whole = back.where("sample_id < 2").withColumn("sample_id", F.col("sample_id") + 100).drop("run", "processed_path")
    store.write_run(whole, root=root)
    both = store.read_samples(spark, root).collect()
    assert len(both) == 42 and {(len(r.residues), len(r.slots)) for r in both} == {(1, 4)}


def test_contacts_of_a_batch_are_those_of_its_nucleotides(spark):
    samples, atoms, motifs = _batch(spark, 1)
    batch = prepare.prepare_batch(samples, atoms, motifs, min_contact=0, min_site=0)
    every = C.contact_labels(C.residue_distances(S.tag_atoms(atoms), *[S.index_kinds(S.residue_table(atoms)).where(f"kind = '{k}'") for k in ("protein", "dna")]))
    named = spark.createDataFrame([("s||", i) for i in (3, 4)], "structure_id string, dna_idx int")
    want = {(r.res_idx, r.dna_idx, r.base_label, r.backbone_label) for r in every.where("dna_idx IN (3, 4)").collect()}
    assert {(r.res_idx, r.dna_idx, r.base_label, r.backbone_label) for r in batch.contacts(named).collect()} == want and want
