import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import metrics as M
from helixframe.operators import motif as O
from helixframe.operators import predictions as P
from helixframe.operators.ordering import dense_index, running_totals
from tests.builders import binary, first, motif_rows, pwm_pair

FLAT = [0.25] * 4
PWM3 = [[0.9, 0.05, 0.03, 0.02], [0.1, 0.8, 0.05, 0.05], [0.1, 0.1, 0.7, 0.1]]


def test_mae_is_position_l1(spark):
    r = first(M.pwm_mae(pwm_pair(spark, [[0.7, 0.1, 0.1, 0.1], FLAT], [[0.1, 0.7, 0.1, 0.1], FLAT])))
    assert r.mae == pytest.approx(0.6)


def test_summary_averages_samples(spark):
    one = pwm_pair(spark, [[1, 0, 0, 0]], [[0, 1, 0, 0]], "a")
    two = pwm_pair(spark, [FLAT] * 3, [FLAT, FLAT, [1, 0, 0, 0]], "b")
    rows = M.pwm_mae(one.union(two))
    got = {r.sample_id: r.mae for r in rows.collect()}
    assert got["a"] == pytest.approx(2.0, abs=1e-6) and got["b"] == pytest.approx(0.5, abs=1e-6)
    s = first(M.summarize_metrics(rows, ["mae"]))
    assert s.n == 2 and s["mean"] == pytest.approx(1.25, abs=1e-6) and s["std"] == pytest.approx(0.75, abs=1e-6)


def test_metrics_ignore_mask_unless_asked(spark):
    pair = pwm_pair(spark, [FLAT, FLAT], [FLAT, [1, 0, 0, 0]]).withColumn("pwm_mask", F.when(F.col("pos") == 0, 1).otherwise(0))
    assert first(M.pwm_metrics(pair)).mae == pytest.approx(0.75, abs=1e-6)
    assert first(M.pwm_metrics(pair, masked=True)).mae == pytest.approx(0.0, abs=1e-6)


def test_perfect_and_reversed_predictions(spark):
    r = first(M.pwm_metrics(pwm_pair(spark, PWM3, PWM3)))
    assert r.mae < 1e-9 and r.kl < 1e-9 and r.ic_pcc == pytest.approx(1.0)
    rc = [row[::-1] for row in PWM3[::-1]]
    r = first(M.pwm_metrics(pwm_pair(spark, PWM3, rc)))
    assert r.kl > 0.1 and r.rc_aware_kl == pytest.approx(0.0, abs=1e-9)


def test_flat_target_has_no_correlation(spark):
    assert first(M.ic_pcc(pwm_pair(spark, [FLAT] * 2, PWM3[:2]))).ic_pcc == 0.0


def test_threshold_diagnostics(spark):
    b = binary(spark, [1, 1, 0, 0], [0.42, 0.38, 0.10, 0.05])
    r = first(M.best_threshold(b, ["grp"]))
    assert r["f1_at_0.5"] == 0.0 and r.best_f1_diagnostic == 1.0
    assert r.best_f1_threshold_diagnostic == 0.38


def test_perfect_ranking(spark):
    b = binary(spark, [1, 1, 0], [0.9, 0.8, 0.1])
    assert first(M.average_precision(b, ["grp"])).ap == 1.0
    assert first(M.top_l_precision(b, ["grp"])).top_l_precision == 1.0
    r = first(M.binary_metrics(b, ["grp"]))
    assert (r.f1, r.mcc) == (1.0, 1.0)


def test_no_positives_is_zero(spark):
    b = binary(spark, [0, 0], [0.9, 0.8])
    assert first(M.average_precision(b, ["grp"])).ap == 0.0
    r = first(M.map_metrics(b, ["grp"]))
    assert (r.ap, r.top_l_precision, r.top_l) == (0.0, 0.0, 0.0)


def reference_ap(rows):
    tp = total = 0
    out = 0.0
    for rank, (_, _, y) in enumerate(sorted((-s, i, y) for i, (y, s) in enumerate(rows)), 1):
        tp += y
        total += y
        out += y * tp / rank
    return out / total if total else 0.0


def test_ranking_with_one_hot_group(spark):
    """A group with most rows, and most of them tied, is still ranked exactly."""
    rng = random.Random(3)
    groups = {"hot": 3000, "b": 40, "c": 1}
    data = {g: [(rng.randint(0, 1), rng.choice([0.1, 0.5, 0.5, 0.5, rng.random()])) for _ in range(n)] for g, n in groups.items()}
    df = spark.createDataFrame([(g, i, y, s) for g, rows in data.items() for i, (y, s) in enumerate(rows)],
                               "grp string, row_id long, y_true int, score double").repartition(7)
    got = {r.grp: r.ap for r in M.average_precision(df, ["grp"]).collect()}
    for g, rows in data.items():
        assert got[g] == pytest.approx(reference_ap(rows))
    pooled = [p for g in ("hot",) for p in data[g]]
    one = first(M.average_precision(df.where("grp = 'hot'"), []))
    assert one.ap == pytest.approx(reference_ap(pooled))


def test_running_totals_and_dense_index(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") % 5).alias("v")).repartition(5)
    got = running_totals(df, ["k"], [F.col("o").asc()], {"s": "v"}).collect()
    want, rank = {}, {}
    for i in range(1000):
        k = i % 3
        want[k] = want.get(k, 0) + i % 5
        rank[k] = rank.get(k, 0) + 1
        i_row = (k, i, rank[k], want[k])
        want.setdefault("rows", set()).add(i_row)
    assert {(r.k, r.o, r["rank"], r.s) for r in got} == want["rows"]
    idx = dense_index(df.withColumn("o", F.col("o") * 7), ["k"], "o", "i", chunk=50)
    assert all(r.i == r.o // 7 // 3 for r in idx.collect())


def test_masked_cells_do_not_count(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 0.9, 1), (1, 0, 1, 1, 0.1, 0)], "sample_id long, res_idx int, slot int, y int, s double, mask int")
    r = first(M.masked_map_metrics(cells, "y", "s", "mask"))
    assert (r.top_l, r.top_l_precision) == (1.0, 1.0)


def loss_cells(spark, label01=0, backbone_label=0, mask01=0, slot_mask=1):
    rows = [(1, i, j, label01 if (i, j) == (0, 1) else 0, backbone_label if j == 1 else 0, 0,
             mask01 if (i, j) == (0, 1) else 1, slot_mask if j == 1 else 1, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0) for i in (0, 1) for j in (0, 1)]
    return spark.createDataFrame(rows, "sample_id long, res_idx int, slot int, base_label int, backbone_label int, contact_label int, "
                                 "base_mask int, pwm_mask int, base_logit double, backbone_logit double, e_a double, e_c double, e_g double, e_t double")


def loss(spark, **kw):
    target = spark.createDataFrame([(1, j, *FLAT) for j in (0, 1)], "sample_id long, slot int, a double, c double, g double, t double")
    return first(P.masked_losses(loss_cells(spark, **kw), target))


def test_unknown_cells_do_not_change_losses(spark):
    a, b = loss(spark), loss(spark, label01=1)
    assert a.loss_A_base == pytest.approx(b.loss_A_base) and a.loss_noncontact == pytest.approx(b.loss_noncontact)
    assert a.loss_A_base == pytest.approx(math.log(2)) and a.loss_pwm == pytest.approx(0.0, abs=1e-12)
    a, b = loss(spark, slot_mask=0), loss(spark, slot_mask=0, backbone_label=1)
    assert a.loss_A_backbone == pytest.approx(b.loss_A_backbone)


def test_sparsity_uses_visible_slots(spark):
    logit = math.log(0.2 / 0.8)
    cells = loss_cells(spark, slot_mask=0).withColumn("base_logit", F.when(F.col("slot") == 0, logit).otherwise(-logit)).withColumn(
        "backbone_logit", F.col("base_logit"))
    target = spark.createDataFrame([(1, j, *FLAT) for j in (0, 1)], "sample_id long, slot int, a double, c double, g double, t double")
    assert first(P.masked_losses(cells, target)).loss_sparse == pytest.approx(0.2)


def test_motif_invariants(spark):
    rows = motif_rows(spark, 1, PWM3)
    twice = O.reverse_complement_pwm(O.reverse_complement_pwm(rows)).orderBy("pos").select("a", "c", "g", "t").collect()
    assert [list(r) for r in twice] == PWM3
    assert all(0 <= r.ic <= 2 for r in O.information_content(O.normalize_pwm(rows)).collect())
    assert first(O.consensus_sequence(rows)).consensus == "ACG"
    trimmed = O.trim_pwm(motif_rows(spark, 1, [FLAT, *PWM3, FLAT, FLAT]))
    assert [r.pos for r in trimmed.orderBy("pos").collect()] == [0, 1, 2]


def test_window_alignment_of_foreign_sequences(spark):
    df = spark.createDataFrame([
        (1, "TTACGTT", "ACG", [2, 3, 4], 3), (2, "TTTGCTT", "ACG", [2, 3, 4], 3), (3, "TTTTCGT", "ACG", [-1, 0, 1], 3),
        (4, "TTTTTTT", "ACG", [0, 1, 2], 3), (5, "TTACGTT", "ACG", [2, 3, 4], 4), (6, "TTACG", "-CG", [-1, 3, 4], 3)],
        "sample_id long, sequence string, target string, slots array<long>, m int")
    rows = {r.sample_id: r for r in P.align_predictions(df).collect()}
    assert rows[1].mode == "slot_index_direct" and rows[2].mode == "slot_index_complement"
    assert rows[3].mode == "window_reverse_complement:4"
    assert rows[4].mode is None and rows[4].error.startswith("could not align")
    assert rows[5].error == "alignment_sequence length 3 != PWM length 4"
    assert rows[6].mode is None


def test_absent_parts_give_absent_metrics(spark):
    """Sample 1 has all, 2 no sites, 3 only its motif pair, 4 a map without positives."""
    cells = [(s, r, 0, int(s != 4 and r == 0), 0, int(s != 4 and r == 0), 1, 1, 0.1 * (r + 1), 0.2, 0.3) for s in (1, 2, 4) for r in range(3)]
    cells = spark.createDataFrame(cells, "sample_id long, res_idx int, slot int, base_label int, backbone_label int, contact_label int, base_mask int, pwm_mask int, a_base double, a_backbone double, a_contact double")
    sites = spark.createDataFrame([(s, r, int(r == 0), 0.5 - 0.1 * r) for s in (1, 4) for r in range(3)], "sample_id long, res_idx int, site_label int, site_prob double")
    pairs = None
    for s in (1, 2, 3):
        one = pwm_pair(spark, [[0.7, 0.1, 0.1, 0.1]], [[0.1, 0.7, 0.1, 0.1]]).withColumn("sample_id", F.lit(s).cast("long"))
        pairs = one if pairs is None else pairs.unionByName(one)
    got = {r.sample_id: r for r in M.evaluate_pair(cells, sites, pairs).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].site_ap == 1.0 and got[1].A_base_ap > 0 and got[1].pwm_mae > 0
    assert got[2].site_ap is None and got[2].n_residue is None and got[2].A_base_ap > 0
    assert got[3].A_base_ap is None and got[3].A_base_pos is None and got[3].pwm_mae > 0
    assert got[4].A_base_ap == 0.0 and got[4].pwm_mae is None and got[4].site_ap == 1.0


def test_running_totals_of_straddling_groups(spark):
    """Groups of one row up to half of the table, over more partitions than groups; ties, NULL sums, totals."""
    rng = np.random.default_rng(3)
    rows = [(str(g), int(i), None if rng.random() < 0.1 else int(rng.integers(0, 5)), float(rng.integers(0, 4))) for g, n in enumerate((4000, 1, 2, 900, 3000, 1)) for i in range(n)]
    rows += [(None, i, 1, 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, row_id long, v int, score double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        out = running_totals(df, ["k"], [F.col("score").desc(), F.col("row_id")], {"s": "v", "x": "score"}, totals={"t": "v"})
        got = {(r.k, r.row_id): (r["rank"], r.s, r.x, r.t) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for k in {r[0] for r in rows}:
        rank = s = x = 0
        total = sum(r[2] or 0 for r in rows if r[0] == k)
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[1])):
            rank, s, x = rank + 1, s + (r[2] or 0), x + r[3]
            want[k, r[1]] = (rank, s, x, total)
    assert got == want
    assert running_totals(df.limit(0), ["k"], [F.col("row_id")], {"s": "v"}, totals={"t": "v"}).count() == 0


def test_rows_are_shuffled_once_for_ranks(spark):
    rows = binary(spark, [0, 1] * 50, np.linspace(0, 1, 100))
    plan = M.ranked(rows, ["grp"], True)._jdf.queryExecution().executedPlan().toString()
    rest = [line for line in plan.split("BroadcastExchange")[0].splitlines() if "Exchange" in line]
    assert "SortMergeJoin" not in plan and not rest and "MapInArrow" in plan
