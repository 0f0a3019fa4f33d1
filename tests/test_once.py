"""What is shared is computed once, and rows are cut before they are sorted."""

from helixframe.operators import contacts as C
from helixframe.operators.ordering import highest_of_runs


def test_rows_below_the_highest_of_a_run_go(spark):
    df = spark.createDataFrame([(k, float(v)) for k in (1, 2) for v in (5, 1, 4, 4, 3, 2)], "k long, v double").coalesce(1)
    assert sorted(map(tuple, highest_of_runs(df, ["k"], "v", 2).collect())) == [(1, 4.0), (1, 4.0), (1, 5.0), (2, 4.0), (2, 4.0), (2, 5.0)]


def test_equal_placements_are_counted_once(spark):
    slots = spark.createDataFrame([(s, "x", k, d) for s, ds in ((1, (0, 1)), (2, (1, 0)), (3, (0, 2))) for k, d in enumerate(ds)], "sample_id long, structure_id string, slot int, dna_idx int")
    contacts = spark.createDataFrame([("x", 7, 0, 1, 0), ("x", 7, 1, 0, 1), ("x", 8, 2, 1, 1)], "structure_id string, res_idx int, dna_idx int, base_label int, backbone_label int")
    asked = []

    def count(one):
        asked.extend(r.sample_id for r in one.select("sample_id").distinct().collect())
        return C.contact_counts(C.sparse_labels(one, contacts))

    got = {r.sample_id: (r.A_base_pos, r.A_backbone_pos, r.A_contact_pos, r.site_pos) for r in C.once_per_placement(slots, count).collect()}
    assert got == {1: (1, 1, 2, 1), 2: (1, 1, 2, 1), 3: (2, 1, 2, 2)} and sorted(asked) == [1, 3]
