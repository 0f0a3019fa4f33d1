"""Components, splits made of them, strict modes, and distances of chosen pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe.operators import audit as U
from helixframe.operators import motif as O
from helixframe.operators import predictions as P
from helixframe.operators import structure as S
from helixframe.operators.graph import connected
from tests.builders import consensus_matrix, motif_rows, toy_complex


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    r = random.Random(1)
    path = list(range(300))
    r.shuffle(path)
    edges = [(f"p{a}", f"p{b}") for a, b in zip(path, path[1:], strict=False)]  # one long path in no order
    edges += [("hub", f"h{i}") for i in range(200)] + [(f"r{r.randrange(300)}", f"r{r.randrange(300)}") for _ in range(220)]
    edges += [("x", "x"), ("y", None), (None, None), ("p5", "p7"), ("p7", "p5")]
    got = {x.node: x.component for x in connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == plain_components(edges)
    assert connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_component_split_shares_nothing_and_fills_evenly(spark):
    r = random.Random(2)
    rows = []
    for c in range(60):  # components of 1 to 40 entries
        for _ in range(r.randrange(1, 40)):
            rows.append((len(rows), f"s{c}_{r.randrange(6)}", f"m{c}_{r.randrange(3)}"))
    rows += [(len(rows) + i, None, "m0_0") for i in range(3)]
    df = spark.createDataFrame(rows, "ord long, structure_id string, motif_id string")
    got = U.leave_component_split(df, 4).collect()
    assert len(got) == len(rows)
    for level in ("structure_id", "motif_id"):
        assert all(len({x.bucket for x in got if x[level] == v}) == 1 for v in {x[level] for x in got})
    size = Counter(x.bucket for x in got)
    largest = max(Counter(x.component for x in got).values())
    assert set(size) == {0, 1, 2, 3} and max(size.values()) <= len(rows) / 4 + largest
    # One component of half the rows takes buckets of its own.
    hot = df.unionByName(spark.range(len(rows)).select((F.col("id") + 10_000).alias("ord"), F.lit("hot").alias("structure_id"), F.concat(F.lit("hm"), F.col("id") % 9).alias("motif_id")))
    alone = {x.bucket for x in U.leave_component_split(hot, 4).where("structure_id = 'hot'").collect()}
    assert len(alone) == 1


def test_strict_modes_name_and_count_what_is_wrong(spark):
    good = motif_rows(spark, 1, consensus_matrix("ACG"))
    assert O.normalize_pwm(good, strict=True).count() == 3
    bad = good.unionByName(spark.createDataFrame([(2, 0, None, 0.2, 0.3, 0.5), (2, 1, float("nan"), 1.0, -1.0, 0.0), (2, 2, 0.1, 0.2, 0.3, 0.4)], good.schema))
    with pytest.raises(ValueError, match="2 unusable matrix rows: .*2 row 1: no shares in A,G"):
        O.normalize_pwm(bad, strict=True).select("pos")  # before any row is read, and whatever columns are
    with pytest.raises(ValueError, match="1 matrices with missing rows: 1: positions"):
        O.normalize_pwm(good.where("pos <> 1"), strict=True)
    preds = spark.createDataFrame([(1, "ACGT", "CG", [1, 2], 2), (2, "ACGT", "GGGG", [0, 1, 2, 3], 4), (3, "ACGT", "A", [0], 2)],
                                  "sample_id long, sequence string, target string, slots array<long>, m int")
    assert [r.error is None for r in P.align_predictions(preds).orderBy("sample_id").collect()] == [True, False, False]
    assert P.align_predictions(preds.where("sample_id = 1"), strict=True).count() == 1
    with pytest.raises(ValueError, match="2 predictions that cannot be aligned: "):
        P.align_predictions(preds, strict=True)


def test_chosen_pairs_have_their_distance_however_far(spark):
    atoms = toy_complex(spark, "TTACGTAA", 3, drop=((4, "N1"),))
    residues = S.index_kinds(S.residue_table(atoms))
    protein, dna = residues.where("kind = 'protein'"), residues.where("kind = 'dna'")
    slots = spark.createDataFrame([(1, "s", 0, 3), (1, "s", 1, 4), (1, "s", 2, -1), (2, "s", 0, 7)], "sample_id long, structure_id string, slot int, dna_idx int")
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 0, 2, 0.7), (2, 0, 0, 0.1), (3, 0, 0, 0.5)], "sample_id long, res_idx int, slot int, score double")
    got = {(r.sample_id, r.slot): (r.base_dist, r.backbone_dist) for r in P.pair_distances(pairs, slots, protein, dna, atoms).collect()}
    far = lambda x, y: pytest.approx((x * x + y * y) ** 0.5)
    assert got == {(1, 0): (0.0, far(103, 5)), (1, 1): (None, far(104, 5)), (1, 2): (None, None), (2, 0): (107.0, far(107, 5)), (3, 0): (None, None)}
