import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.operators import geometry as G


def cloud(spark, n, seed, name, spread):
    rng = random.Random(seed)
    pts = [("s%d" % (i % 2), i, *(round(rng.uniform(-spread, spread), 3) for _ in range(3))) for i in range(n)]
    return pts, spark.createDataFrame(pts, f"structure_id string, {name} int, x double, y double, z double")


@pytest.mark.parametrize("cells", [0.5, 1.0, 2.0])
def test_grid_join_equals_brute_force(spark, cells):
    a, da = cloud(spark, 120, 1, "a_id", 15)
    b, db = cloud(spark, 90, 2, "b_id", 15)
    got = {(r.a_id, r.b_id) for r in G.near_pairs(da, db, 6.0, cells_per_cutoff=cells).where("sqrt(d2) <= 6.0").collect()}
    want = {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and math.dist(p[2:], q[2:]) <= 6.0}
    assert got == want and len(want) > 100


def test_each_pair_once(spark):
    _, da = cloud(spark, 80, 3, "a_id", 5)
    _, db = cloud(spark, 80, 4, "b_id", 5)
    pairs = G.near_pairs(da, db, 4.0).select("a_id", "b_id")
    assert pairs.count() == pairs.distinct().count()


def test_graph_drops_coincident_points(spark):
    pts = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0), ("s", 1, 0.0, 0.0, 0.0), ("s", 2, 14.0, 0.0, 0.0), ("s", 3, 13.9, 0.0, 0.0)],
                                "structure_id string, res_idx int, x double, y double, z double")
    got = {(r.src, r.dst) for r in G.residue_graph_edges(pts).collect()}
    assert got == {(0, 3), (3, 0), (1, 3), (3, 1), (2, 3), (3, 2)}


def test_isolated_nodes_stay_zero(spark):
    nodes = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0, 1.0), ("s", 1, 1.0, 0.0, 0.0, 2.0), ("s", 2, 90.0, 0.0, 0.0, 3.0)],
                                  "structure_id string, res_idx int, x double, y double, z double, f double")
    edges = G.residue_graph_edges(nodes).withColumn("gate", F.lit(1.0))
    rows = {r.res_idx: r for r in G.neighbor_aggregate(nodes, edges, ["f"]).collect()}
    assert (rows[2].degree, rows[2].sum_f, rows[2].shift_x) == (0, 0.0, 0.0)
    assert (rows[0].degree, rows[0].sum_f) == (1, 2.0) and rows[0].shift_x == pytest.approx(-0.1)


def test_rbf_has_one_at_its_center(spark):
    row = spark.range(1).select(G.rbf_encode(F.lit(20.0 / 15 * 3)).alias("v")).collect()[0].v
    assert len(row) == 16 and row[3] == pytest.approx(1.0) and row[4] == pytest.approx(math.exp(-1))
