"""Batch preparation on inline structures, and its own sinks."""

from pyspark.sql import functions as F

from helixframe.operators import predictions as P
from helixframe.operators import prepare
from helixframe.operators.audit import median_metric
from helixframe.sources import sinks as K
from tests.builders import consensus_matrix, motif_rows, toy_complex


def test_prepared_rows_feed_the_status_tables(spark, tmp_path):
    atoms = toy_complex(spark, "TTACGTAA", 3)
    atoms = atoms.withColumn("parse_error", F.lit(None).cast("string"))
    atoms = atoms.unionByName(atoms.withColumn("structure_id", F.lit("bad")).withColumn(
        "parse_error", F.when(F.col("atom_ord") == 1, "unreadable atom line")))
    motifs = motif_rows(spark, 7, consensus_matrix("ACGT"))
    rows = [(f"{s}_{m}", "train", s, "", "pdb", "", "", m, "J", "v", "m.txt", "") for s in ("s", "bad", "none") for m in (7, 8)]
    samples = spark.createDataFrame(rows, "sample_id string, split string, structure_id string, structure_path string, structure_format string, "
                                          "protein_chains string, dna_chains string, motif_id long, motif_source string, motif_version string, motif_path string, notes string")
    K.write_prepared(prepare.prepare_batch(samples, atoms, motifs, min_contact=0, min_site=0), str(tmp_path))
    labels = spark.read.parquet(f"{tmp_path}/labels").collect()
    assert [(r.sample_id, r.split, len(r.slots)) for r in labels] == [("s_7", "train", 4)]
    touched = [x.slot for x in labels[0].slots if x.base_res]
    assert touched == [labels[0].slots[k].slot for k in range(4) if labels[0].slots[k].dna_idx == 3] and all(x.base_mask == x.pwm_mask == 1 for x in labels[0].slots)
    status = {r.sample_id: r for r in spark.read.parquet(f"{tmp_path}/status").collect()}
    assert len(status) == 6 and status["bad_7"].reason == "unreadable atom line"
    assert status["none_7"].reason.startswith("structure file not found") and status["s_8"].reason.startswith("motif file not found")
    assert status["s_7"].status == "ok" and status["s_7"].split == "train"
    ok = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/sample_table").collect()
    assert [(r.sample_id, r.motif_source) for r in ok] == [("s_7", "J")]


def test_incomplete_ensembles_have_no_mean(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 1, 4.0), (2, 0, 5.0)], "k long, model_id long, x double")
    got = {r.k: (r.x, r.error) for r in P.ensemble_mean(rows, ["k"], ["x"], 2).collect()}
    assert got == {1: (3.0, None), 2: (None, "expected 2 models, got 1")}
    assert {r.k: r.x for r in P.ensemble_mean(rows, ["k"], ["x"]).collect()} == {1: 3.0, 2: 5.0}


def test_unknown_split_is_not_the_global_row(spark):
    rows = spark.createDataFrame([("a", None), (None, None), (None, "x")], "split string, reason string")
    got = {r.split: (r.success, r.failure) for r in prepare.failure_pivot(rows).collect()}
    assert got == {"a": (1, 0), None: (1, 1), "global": (2, 1)}


def test_median_with_one_value_everywhere(spark):
    rows = spark.range(20_000).select(F.lit("m").alias("method"), F.lit(3.5).alias("x"))
    more = spark.createDataFrame([("n", 1.0), ("n", 2.0), ("n", 2.0), ("n", 9.0), ("o", 1.0), ("o", 4.0)], "method string, x double")
    got = {r.method: (r["median"], r.n) for r in median_metric(rows.unionByName(more), "x").collect()}
    assert got == {"m": (3.5, 20_000), "n": (2.0, 4), "o": (2.5, 2)}
