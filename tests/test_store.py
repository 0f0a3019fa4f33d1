"""From a manifest through files to stored samples and back; later runs; runs that broke off."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.constants import MANIFEST_COLUMNS
from helixframe.operators import contacts as C
from helixframe.operators import prepare
from helixframe.operators.manifest import require_inputs
from helixframe.sources import sinks, store
from helixframe.sources.motifs import read_pwm_files
from helixframe.sources.structures import read_structures
from tests.builders import consensus_matrix, motif_rows, toy_complex

PDB = "ATOM  {n:5d} {name:<4s} {res:>3s} {chain}{seq:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00          {el:>2s}"


def write_inputs(folder):
    """Two structures (the second lacks a backbone in one nucleotide) and a motif as files."""
    os.makedirs(f"{folder}/in")
    for name, drop in (("s", None), ("t", 1)):
        lines = [PDB.format(n=1, name="CZ", res="ARG", chain="A", seq=1, x=0, y=0, z=0, el="C"), PDB.format(n=2, name="CA", res="GLY", chain="A", seq=2, x=3, y=0, z=0, el="C")]
        for i, b in enumerate("TTACGTAA"):
            x = 1.0 if i == 3 else 100.0 + i
            lines.append(PDB.format(n=len(lines) + 1, name="N1", res="D" + b, chain="B", seq=i + 1, x=x, y=0, z=0, el="N"))
            if i != drop:
                lines.append(PDB.format(n=len(lines) + 1, name="P", res="D" + b, chain="B", seq=i + 1, x=100.0 + i, y=5, z=0, el="P"))
        with open(f"{folder}/in/{name}.pdb", "w") as f:
            f.write("\n".join(lines) + "\n")
    with open(f"{folder}/in/7.txt", "w") as f:
        f.write("A C G T\n" + "\n".join("\t".join(map(str, r)) for r in consensus_matrix("ACGT")) + "\n")


def manifest_of(spark, folder, rows):
    """(sample_id, structure_id, policy, manual_index, manual_start) -> manifest rows with their files."""
    kinds = "sample_id string, structure_id string, policy string, manual_index string, manual_start int"
    m = spark.createDataFrame(rows, kinds).withColumn("ord", F.monotonically_increasing_id())
    m = m.withColumn("structure_path", F.concat(F.lit(f"{folder}/in/"), "structure_id", F.lit(".pdb"))).withColumn("motif_path", F.lit(f"{folder}/in/7.txt"))
    fixed = {"split": "train", "structure_format": "pdb", "protein_chains": "", "dna_chains": "", "motif_id": "7", "motif_source": "J", "motif_version": "v", "notes": ""}
    return m.withColumns({k: F.lit(v) for k, v in fixed.items()}).select("ord", *MANIFEST_COLUMNS, "policy", "manual_index", "manual_start")


@pytest.fixture
def inputs(spark, tmp_path):
    write_inputs(str(tmp_path))
    atoms = read_structures(spark, f"{tmp_path}/in/*.pdb")
    motifs = read_pwm_files(spark, f"{tmp_path}/in/*.txt")
    rows = [("a", "s", None, None, None), ("b", "t", "sequence_only", None, None), ("c", "s", None, "0,1,2,3", None), ("d", "s", None, None, 2),
            ("e", "t", None, None, None), ("f", "gone", None, None, None), ("g", "s", None, "0,1", None), ("h", "t", None, "0,2,-1,9", None), ("i", "t", None, None, 1)]
    return str(tmp_path), atoms, motifs, manifest_of(spark, str(tmp_path), rows)


def test_policies_of_a_batch(spark, inputs):
    _, atoms, motifs, manifest = inputs
    got = {r.sample_id: r for r in prepare.prepare_samples(manifest, atoms, motifs, min_contact=0, min_site=0).collect()}
    mode = {k: (r.alignment_mode, r.alignment_score_mode) for k, r in got.items() if r.error is None}
    assert mode == {"a": ("contact_constrained_pwm_dna", "ic_log_likelihood"), "b": ("auto_pwm_dna", "ic_log_likelihood"),
                    "c": ("manual_slot_to_dna_index", "manual"), "d": ("manual_dna_start_index", "manual")}
    assert list(got["a"].slot_to_dna_index) == list(got["b"].slot_to_dna_index) == [2, 3, 4, 5]
    assert got["a"].alignment_candidate_count == 10 and got["b"].alignment_candidate_count == 0  # not counted without contacts
    assert list(got["c"].slot_to_dna_index) == [0, 1, 2, 3] and list(got["d"].slot_to_dna_index) == [2, 3, 4, 5]
    assert [(got[k].A_base_pos, got[k].site_pos) for k in "abcd"] == [(2, 2)] * 4
    error = {k: r.error for k, r in got.items() if r.error}
    assert error["e"].startswith("DNA residue B:2") and error["i"] == error["e"]  # any window, and the window itself
    assert error["f"].startswith("structure file not found") and error["g"] == "--slot-to-dna-index length 2 != PWM length 4."
    assert error["h"] == "slot_to_dna_index out of range for selected DNA residues: 0..7."


def test_second_run_computes_nothing_and_filters_anew(spark, inputs, monkeypatch):
    folder, atoms, motifs, manifest = inputs
    root = f"{folder}/out"
    good = manifest.where("sample_id IN ('a', 'b', 'c')")
    first = {r.sample_id: r for r in prepare.prepare_manifest(good, atoms, motifs, root).collect()}
    assert {r.status for r in first.values()} == {"ok"} and len(store.committed_runs(spark, root)) == 1
    # The second run has no batch to prepare; other minimums, the same counts.
    with monkeypatch.context() as m:
        m.setattr(prepare, "prepare_batch", lambda *a, **k: pytest.fail("computed again"))
        second = {r.sample_id: r for r in prepare.prepare_manifest(good, atoms, motifs, root, min_base=3).collect()}
        again = prepare.prepare_manifest(good, atoms, motifs, root).collect()
    assert {r.status for r in second.values()} == {"skip"} and all(second[k].A_base_pos == first[k].A_base_pos == 2 for k in first)
    assert second["a"].reason == "filtered_low_contact A_base_pos=2 A_backbone_pos=0 A_contact_pos=2 site_pos=2"
    assert {r.sample_id: (r.run, r.processed_path, r.status) for r in again} == {k: (r.run, r.processed_path, "ok") for k, r in first.items()}
    # More rows: only the new ones are computed, stored ones keep their run; a file that went fails a stored sample too.
    with_files = require_inputs(manifest.withColumn("structure_file", F.col("structure_path")).withColumn("motif_file", F.col("motif_path")),
                                spark.createDataFrame([(f"{folder}/in/{f}",) for f in ("s.pdb", "7.txt")], "path string"))
    third = {r.sample_id: r for r in prepare.prepare_manifest(with_files, atoms, motifs, root).collect()}
    assert third["a"].run == first["a"].run < third["d"].run and third["b"].status == "fail" and "t.pdb" in third["b"].reason
    assert third["g"].reason.startswith("--slot-to-dna-index") and third["f"].reason.startswith("structure file not found")
    assert {k for k, r in third.items() if r.status == "ok"} == {"a", "c", "d"}
    # With overwrite all are computed again and the latest run counts; removed samples are computed by the next run.
    newer = prepare.prepare_manifest(good, atoms, motifs, root, overwrite=True).collect()
    assert len({r.run for r in newer}) == 1 and newer[0].run > third["d"].run
    fourth = prepare.prepare_manifest(good, atoms, motifs, root, drop_filtered=True, min_base=3).collect()
    assert {r.status for r in fourth} == {"skip"} and all(r.processed_path is None for r in fourth)
    assert [r.sample_id for r in store.read_samples(spark, root, []).collect()] == ["d"]
    fifth = prepare.prepare_manifest(good, atoms, motifs, root).collect()
    assert {r.status for r in fifth} == {"ok"} and len({r.run for r in fifth} - {r.run for r in fourth}) == 1


def test_tables_name_what_exists(spark, inputs):
    folder, atoms, motifs, manifest = inputs
    root = f"{folder}/out"
    status = prepare.prepare_manifest(manifest, atoms, motifs, root)
    sinks.write_status(status, root)
    table = spark.read.option("sep", "\t").option("header", True).csv(f"{root}/sample_table").collect()
    assert {r.sample_id for r in table} == {"a", "b", "c", "d"}
    for r in table:
        held = spark.read.parquet(f"{root}/{r.processed_path}").where(F.col("sample_id") == r.sample_id).collect()
        assert len(held) == 1 and str(held[0].A_contact_pos) == r.A_contact_pos
    listed = {r.value for r in spark.read.text(f"{root}/processed_manifest").collect()}
    assert listed == {r.processed_path for r in table}
    failed = {r.sample_id for r in spark.read.option("sep", "\t").option("header", True).csv(f"{root}/failed").collect()}
    assert failed == set("efghi")


def test_arrays_are_read_back(spark, inputs):
    folder, atoms, motifs, manifest = inputs
    root = f"{folder}/out"
    vectors = spark.createDataFrame([("s||", 0, [1.0, 2.0])], "structure_id string, sel_idx int, vector array<double>")
    prepare.prepare_manifest(manifest, atoms, motifs, root, vectors=vectors)
    samples = store.read_samples(spark, root)
    got = {r.sample_id: r for r in store.dense_arrays(samples).collect()}
    a = got["a"]
    assert [(r.res_idx, r.residue_id, r.aa, r.x, r.y, r.z) for r in a.residues] == [(0, "A:1", "R", 0, 0, 0), (1, "A:2", "G", 3, 0, 0)]
    assert [r.vector for r in a.residues] == [[1.0, 2.0], None]
    assert [(e.src, e.dst, e.dist, len(e.edge_attr)) for e in a.edges] == [(0, 1, 3.0, 17), (1, 0, 3.0, 17)]
    np.testing.assert_allclose([[x.a, x.c, x.g, x.t] for x in a.pwm], consensus_matrix("ACGT"), atol=1e-9)
    assert a.base_label == [[0, 1, 0, 0], [0, 1, 0, 0]] and a.contact_label == a.base_label and a.backbone_label == [[0] * 4] * 2
    assert a.base_mask == [[1] * 4] * 2 and a.site_label == [1, 1] and a.pwm_mask == [1] * 4 and a.slot_to_dna_index == [2, 3, 4, 5]
    # The cells are those that the labels of the batch make.
    cells = store.sample_cells(samples)
    counts = {r.sample_id: (r.A_base_pos, r.A_backbone_pos, r.A_contact_pos, r.site_pos) for r in C.contact_counts(cells).collect()}
    assert counts == {k: (r.A_base_pos, r.A_backbone_pos, r.A_contact_pos, r.site_pos) for k, r in got.items()}


def test_a_run_that_broke_off_does_not_count(spark, inputs):
    folder, atoms, motifs, manifest = inputs
    root = f"{folder}/out"
    good = manifest.where("sample_id IN ('a', 'd')")
    prepare.prepare_manifest(good.where("sample_id = 'a'"), atoms, motifs, root)
    whole = store.read_samples(spark, root)
    # All files of a second run are there, its name is not.
    whole.withColumn("sample_id", F.lit("d")).drop("run", "processed_path").write.parquet(f"{root}/processed/run=000001-feedbeef")
    assert [r.sample_id for r in store.read_samples(spark, root, []).collect()] == ["a"]
    got = {r.sample_id: r.run for r in prepare.prepare_manifest(good, atoms, motifs, root).collect()}
    assert len(set(got.values())) == 2 and "000001-feedbeef" not in got.values()


def test_packing_shuffles_residues_and_edges_once(spark):
    atoms = toy_complex(spark, "TTACGTAA", 3)
    samples = spark.createDataFrame([("x", "s", 7, "", ""), ("y", "s", 7, "", "")], "sample_id string, structure_id string, motif_id long, protein_chains string, dna_chains string")
    batch = prepare.prepare_batch(samples, atoms, motif_rows(spark, 7, consensus_matrix("ACGT")), min_contact=0, min_site=0)
    packed = batch.packed()
    assert {r.sample_id: (len(r.residues), len(r.slots)) for r in packed.collect()} == {"x": (1, 4), "y": (1, 4)}
    assert store.read_samples(spark, "/no/such/folder") is None


def test_other_writers_are_read_back(spark, tmp_path):
    from helixframe.operators import samples as P
    from helixframe.sources.manifests import read_motif_index

    index = spark.createDataFrame([(f"M{i}", "J", str(i), f"{tmp_path}/idx/m/{i}.txt") for i in range(30)], "motif_id string, motif_source string, motif_version string, motif_path string")
    sinks.write_motif_index(index, f"{tmp_path}/idx")
    back = read_motif_index(spark, f"{tmp_path}/idx").collect()
    assert sorted((r.motif_id, r.motif_version, r.motif_path) for r in back) == sorted((f"M{i}", str(i), f"m/{i}.txt") for i in range(30))
    cells = spark.createDataFrame([(k, "train" if k else "valid", r, s, r + 0.5 * s) for k in range(2) for r in range(3) for s in range(2)], "sample_id long, split string, res_idx int, slot int, v double")
    sinks.write_samples(P.pack_samples(cells, ["v"], ["sample_id", "split"]), f"{tmp_path}/samples")
    only = spark.read.parquet(f"{tmp_path}/samples").where("split = 'train'")
    got = P.unpack_samples(only, ["v"], ["sample_id"])
    assert sorted(map(tuple, got.collect())) == sorted((1, r, s, r + 0.5 * s) for r in range(3) for s in range(2))
    assert "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().executedPlan().toString()
