"""Work and memory of a task stay in proportion to its rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helixframe.functions import window_scores
from helixframe.operators import contacts as C
from helixframe.operators import geometry as G
from helixframe.operators import manifest as N
from helixframe.operators import prepare
from helixframe.operators.prepare import Prepared
from helixframe.sources import motifs as SMo
from helixframe.sources import store


def test_lines_of_a_motif_are_made_once(spark):
    lines = spark.range(4).select(F.lit(7).alias("motif_id"), F.col("id").cast("int").alias("line_no"), F.format_string("%d 1 2 %d", "id", "id").alias("value"))
    rows = SMo.scan_pwm_text(lines)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("format_string(") == 1
    assert [(r.pos, round(r.c, 6)) for r in rows.orderBy("pos").collect()] == [(0, 0.333333), (1, 0.2), (2, 0.142857), (3, 0.111111)]


def test_entries_meet_the_pool_in_all_partitions(spark):
    parsed = spark.createDataFrame([(f"s{k % 5}", "A", f"m{k % 3}", k) for k in range(20)], "structure_id string, chain string, motif_id string, ord long")
    pool = spark.createDataFrame([("s0_A_m0",), ("s1_A_m1",), ("s1_A_m1",), (None,)], "sample_id string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        have, lack = N.split_rebuild(parsed, pool)
        assert have.rdd.getNumPartitions() == lack.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(r.ord for r in have.collect()) == [0, 1, 15, 16] and sorted(r.ord for r in lack.collect()) == sorted({*range(20)} - {0, 1, 15, 16})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_selections_are_packed_in_all_partitions(spark):
    status = spark.createDataFrame([(k, f"x|{k}|", 1, [0], "ok", None, None) for k in range(3)], "sample_id long, selection string, motif_id long, slot_to_dna_index array<int>, status string, reason string, error string")
    protein = spark.createDataFrame([(f"x|{k}|", i, "A", i, "", "ARG", float(i), 0.0, 0.0) for k in range(3) for i in (2, 0, 1)],
                                    "structure_id string, sel_idx int, chain string, resseq int, icode string, resname string, x double, y double, z double")
    edges = spark.createDataFrame([(f"x|{k}|", i, j, float(abs(i - j))) for k in range(3) for i in range(3) for j in range(3) if i != j], "structure_id string, src int, dst int, dist double")
    contacts = spark.createDataFrame([], "structure_id string, res_idx int, dna_idx int, base_label int, backbone_label int")
    missing = spark.createDataFrame([], "structure_id string, dna_idx int, part string")
    motifs = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0)], "motif_id long, pos int, a double, c double, g double, t double")
    shared = Prepared(status, lambda used: contacts, missing, protein, edges, motifs).parts()[1]
    assert shared.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = shared.collect()
    assert sorted(r.selection for r in rows) == ["x|0|", "x|1|", "x|2|"]
    assert all([x.res_idx for x in r.residues] == [0, 1, 2] and [(e.src, e.dst) for e in r.edges] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)] for r in rows)


def test_graphs_are_packed_in_blocks(spark, monkeypatch):
    """A row holds some residues with the edges that begin there; selections that differ in DNA chains share a graph."""
    monkeypatch.setattr(prepare, "EDGE_BLOCK", 12)
    n = 6
    status = spark.createDataFrame([(k, "x", "", d, f"x||{d}", 1, [0], "ok", None, None) for k, d in enumerate("BC")], "sample_id long, structure_id string, protein_chains string, "
                                   "dna_chains string, selection string, motif_id long, slot_to_dna_index array<int>, status string, reason string, error string")
    protein = spark.createDataFrame([(f"x||{d}", i, "A", i, "", "ARG", float(i), 0.0, 0.0) for d in "BC" for i in reversed(range(n))],
                                    "structure_id string, sel_idx int, chain string, resseq int, icode string, resname string, x double, y double, z double")
    contacts = spark.createDataFrame([("x||B", 4, 0, 1, 0), ("x||C", 1, 0, 0, 1)], "structure_id string, res_idx int, dna_idx int, base_label int, backbone_label int")
    missing = spark.createDataFrame([], "structure_id string, dna_idx int, part string")
    motifs = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0)], "motif_id long, pos int, a double, c double, g double, t double")
    edges = lambda chosen: G.sized_edges(chosen.select("structure_id", F.col("sel_idx").alias("res_idx"), "x", "y", "z"))
    batch = prepare.Prepared(status, lambda used: contacts, missing, protein, edges, motifs)
    own, shared = batch.parts()
    assert {r.graph for r in own.collect()} == {"x||B"}
    rows = sorted(shared.collect(), key=lambda r: r.block)
    assert [(r.selection, [x.res_idx for x in r.residues], len(r.edges)) for r in rows] == [("x||B", [0, 1], 10), ("x||B", [2, 3], 10), ("x||B", [4, 5], 10)]
    assert all(len(e.edge_attr) == 17 and e.edge_attr[16] > 0 for r in rows for e in r.edges)
    packed = {r.sample_id: r for r in batch.packed().collect()}
    every = [(i, j, float(abs(i - j))) for i in range(n) for j in range(n) if i != j]
    assert all([(e.src, e.dst, e.dist) for e in r.edges] == every and [x.res_idx for x in r.residues] == [*range(n)] for r in packed.values())
    # Matrices that only sums of leave the task.
    names = ["base_label", "base_mask", "backbone_label", "contact_label", "site_label"]
    whole = {r.sample_id: r for r in store.dense_arrays(batch.packed()).collect()}
    light = own.join(shared.groupBy(F.col("selection").alias("graph")).agg(F.sum(F.size("residues")).cast("int").alias("n_res")), "graph")
    sums = {r.sample_id: r for r in store.dense_arrays(light, names).collect()}
    total = lambda x: sum(map(total, x)) if isinstance(x, list) else x
    assert whole[0].base_label == [[0]] * 4 + [[1], [0]] and whole[1].backbone_label == [[0], [1]] + [[0]] * 4 and whole[1].site_label == [0, 1, 0, 0, 0, 0]
    assert {k: [total(r[c]) for c in names] for k, r in whole.items()} == {k: [r[c] for c in names] for k, r in sums.items()} == {0: [1, 6, 0, 1, 1], 1: [0, 6, 1, 1, 1]}
    assert "slots" not in sums[0].asDict() and sums[0].slot_to_dna_index == [0]


def test_slots_and_residues_meet_in_all_partitions(spark):
    """Whatever the size of either side: they are small, what they make is not. Slots fill several blocks."""
    n = 1300
    centers = spark.createDataFrame([(k, "s", 0, k % 2, *((3.0, 0.0, 0.0) if k % 2 == 0 else (None,) * 3)) for k in range(n)],
                                    "sample_id long, structure_id string, slot int, dna_idx int, base_x double, base_y double, base_z double")
    points = spark.createDataFrame([("s", i, float(i), 0.0, 0.0) for i in range(12)], "structure_id string, res_idx int, x double, y double, z double")
    got = C.residue_slot_geometry(centers, points, 5.0, lambda c: F.round(c, 1))
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sorted((r.sample_id, r.res_idx, r.slot, r.dist, r.dir_x) for r in got.collect())
    near = [(i, float(abs(3 - i)), None if i == 3 else (1.0 if i < 3 else -1.0)) for i in range(9)]
    assert rows == [(k, i, 0, dist, way) for k in range(0, n, 2) for i, dist, way in near]


def test_a_batch_of_windows_makes_no_object_a_row():
    n, m = 4000, 8
    lists = lambda k: pa.ListArray.from_arrays(pa.array(range(0, n * k + 1, k), pa.int32()), pa.array(np.ones(n * k)))
    none = pa.array([[]] * n, pa.list_(pa.float64()))
    columns = (pa.array(["ACGTACGT"] * n), lists(4 * m), lists(m), none, pa.array([True] * n), pa.array([m] * n), pa.array([1] * n))
    tracemalloc.start()
    try:
        best = window_scores._best_candidate(*columns)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(best) == n and best.field("raw").to_pylist() == [1.0] * n
    assert peak < 1_200_000, peak
