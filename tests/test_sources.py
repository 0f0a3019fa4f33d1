import os
import re
import time

import pytest
from pyspark.sql import functions as F

from helixframe.operators import manifest as N
from helixframe.operators import structure as S
from helixframe.sources import manifests as SM
from helixframe.sources import motifs as SMo
from helixframe.sources import sinks as K
from helixframe.sources import structures as SS
from helixframe.sources.text import number_lines, read_lines, read_whole

CIF = """data_small
_cell.length_a 10.0
loop_
_atom_site.id
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.auth_asym_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.type_symbol
_atom_site.pdbx_PDB_ins_code
11 ATOM N . ARG A 10 0.5 -1.5 2.25 N ?
12 ATOM CA . ARG A 10 1.5 -1.5 2.25 C ?
20 HETATM P . DA B 1 7.0 8.0 9.0 P ?
21 HETATM N1 . DA B 1 7.5 8.0
9.5 N ? 22 ATOM "C1'" . DA B 1 7.5 8.5 9.5 C ?
23 ATOM N . ARG A 99999999999 0.0 0.0 0.0 N ?
loop_
_other.id
1
"""
PDB = (
    "ATOM      1  N   ARG A  10A      1.000   2.000   3.000  1.00 20.00           N\n"
    "ATOM      2  CA BARG A  10A      1.000   2.000   3.000  1.00 20.00           C\n"
    "HETATM    3 1HB  ARG    10       1.500   2.000  -3.000\n"
    "TER\n"
)


def test_read_structures(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    (tmp_path / "b.pdb").write_text(PDB)
    atoms = SS.read_structures(spark, str(tmp_path)).cache()
    res = S.group_residues(atoms.where("structure_id = 'a'")).select("*", S.residue_id().alias("rid"), S.residue_kind().alias("k"))
    rows = {r.rid: r for r in res.collect()}
    assert rows["A:10"].k == "protein" and rows["A:10"].n_atoms == 2
    assert rows["B:1"].resname == "DA" and rows["B:1"].n_atoms == 3
    b = atoms.where("structure_id = 'b'").orderBy("atom_ord").collect()
    assert [(r.name, r.chain, r.resseq, r.icode, r.element, r.z) for r in b] == [
        ("N", "A", 10, "A", "N", 3.0), ("1HB", "_", 10, "", "H", -3.0)]


def test_unreadable_pdb_line_is_marked(spark):
    bad = PDB.splitlines()[0].replace("  10A", "  xxA")
    lines = spark.createDataFrame([("s", 0, bad)], "structure_id string, line_no int, value string")
    assert SS.scan_pdb_atoms(lines).collect()[0].parse_error == "unreadable atom line"


def test_pwm_files(spark, tmp_path):
    (tmp_path / "m1.txt").write_text("A C G T\n1 0.1 0.2 0.3 0.4\n[0.25, 0.25, 0.25, 0.25]\n")
    (tmp_path / "m2.txt").write_text("letter-probability matrix: alength= 4\n0.7 0.1 0.1 0.1\nURL x\n0.1 0.1 0.1 0.7\n")
    got = SMo.read_pwm_files(spark, str(tmp_path)).orderBy("motif_id", "pos").collect()
    assert [(r.motif_id, r.pos) for r in got] == [("m1", 0), ("m1", 1), ("m2", 0)]
    assert got[0].t == pytest.approx(0.4) and got[2].a == pytest.approx(0.7)


def test_collections(spark):
    jaspar = ">MA0001.1\tTEST\nA  [ 1 2 ]\nC  [ 3 4 ]\nG  [ 5 6 ]\nT  [ 7 8 ]\n>UN0124.1\tX\nA  [ 5 ]\nC  [ 6 ]\nG  [ 7 ]\nT  [ 8 ]\n"
    t = spark.createDataFrame([("p", jaspar)], "path string, text string")
    got = {(r.motif_id, r.pos): (r.a, r.c, r.g, r.t) for r in SMo.scan_jaspar_collection(t).collect()}
    assert got == {("MA0001.1", 0): (1, 3, 5, 7), ("MA0001.1", 1): (2, 4, 6, 8), ("UN0124.1", 0): (5, 6, 7, 8)}
    hoco = ">AHR_HUMAN.H11MO.0.B\n1 2\n3 4\n5 6\n7 8\n>FOO_HUMAN.H11MO.0.A\n10\n20\n30\n40\n>BAD\n1\n2\n"
    t = spark.createDataFrame([("p", hoco)], "path string, text string")
    got = {(r.motif_id, r.pos): (r.a, r.c, r.g, r.t) for r in SMo.scan_hocomoco_collection(t).collect()}
    assert got[("AHR_HUMAN.H11MO.0.B", 1)] == (2, 4, 6, 8) and got[("FOO_HUMAN.H11MO.0.A", 0)] == (10, 20, 30, 40)
    assert [(r.motif_id, r.error) for r in SMo.hocomoco_errors(t).collect()] == [("BAD", "BAD: expected 4 base rows, got 2")]
    twice = SMo.hocomoco_errors(t.unionByName(t.withColumn("path", F.lit("other"))))
    assert sorted((r.path == "other", r.motif_id) for r in twice.collect()) == [(False, "BAD"), (True, "BAD")]


def test_manifest_round_trip(spark, tmp_path):
    src = tmp_path / "in.tsv"
    cols = SM.MANIFEST_REQUIRED
    src.write_text("\t".join(cols) + "\n" + "\t".join(["toy_1", "1ABC", "pdbx", "A", "B,C", "M1", "JASPAR", "v1", "pwms/m1.txt"]) + "\n"
                   + "\t".join(["toy_2", "", "pdb", "A", "", "M1", "JASPAR", "v1", "/x/m.txt"]) + "\n")
    rows = N.validate_manifest(SM.read_source_manifest(spark, str(src))).collect()
    assert [r.error for r in sorted(rows, key=lambda r: r.sample_id)] == [None, "toy_2: empty structure_id"]
    ok = N.resolve_paths(N.validate_manifest(SM.read_source_manifest(spark, str(src))).where("error IS NULL"), "/m", "/cache").collect()[0]
    assert (ok.structure_file, ok.motif_file) == ("/cache/1abc.cif", "/m/pwms/m1.txt")
    out = str(tmp_path / "out")
    K.write_source_manifest(N.validate_manifest(SM.read_source_manifest(spark, str(src))).where("error IS NULL"), out, "/m")
    back = SM.read_source_manifest(spark, out).collect()
    assert back[0].sample_id == "toy_1" and back[0].structure_format == "cif" and back[0].motif_path == "/m/pwms/m1.txt"
    assert back[0].structure_path == back[0].notes == back[0].split == ""
    again = N.resolve_paths(N.validate_manifest(SM.read_source_manifest(spark, out)), "/m", "/cache").collect()[0]
    assert (again.structure_file, again.motif_file) == ("/cache/1abc.cif", "/m/pwms/m1.txt")


def test_quoted_cells_come_back(spark, tmp_path):
    row = {c: "x" for c in SM.MANIFEST_COLUMNS} | {"notes": 'says "so"', "split": "a\tb", "structure_path": ""}
    df = spark.createDataFrame([row], SM.MANIFEST_SCHEMA)
    K.write_tsv(df.select(*SM.MANIFEST_COLUMNS), str(tmp_path / "q"))
    back = SM.read_source_manifest(spark, str(tmp_path / "q")).drop("ord").collect()
    assert [r.asDict() for r in back] == [row]


def test_empty_manifest_is_refused(spark, tmp_path):
    p = tmp_path / "none.tsv"
    p.write_text("\t".join(SM.MANIFEST_REQUIRED) + "\n")
    with pytest.raises(ValueError, match="no rows"):
        SM.read_source_manifest(spark, str(p))


def test_collections_keep_files_apart(spark):
    record = ">M\nA [ {0} ]\nC [ {0} ]\nG [ {0} ]\nT [ {0} ]\n"
    t = spark.createDataFrame([("p", record.format(1)), ("q", record.format(2))], "path string, text string")
    assert sorted((r.path, r.a, r.t) for r in SMo.scan_jaspar_collection(t).collect()) == [("p", 1, 1), ("q", 2, 2)]
    t = spark.createDataFrame([("p", ">M\n1\n1\n1\n1\n"), ("q", ">M\n2\n2\n2\n2\n")], "path string, text string")
    assert sorted((r.path, r.a, r.t) for r in SMo.scan_hocomoco_collection(t).collect()) == [("p", 1, 1), ("q", 2, 2)]


def test_report_files_have_header_and_order(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.5, 1.0), (1, None, 2.0)], "sample_id long, pwm_mae double, zz double")
    summary = spark.createDataFrame([("zz", 1.5, 0.5, 2), ("pwm_mae", 0.5, 0.0, 1)], "metric string, mean double, std double, n long")
    K.write_eval_report(rows, summary, ["zz", "pwm_mae"], str(tmp_path / "r"))
    lines = lambda name: [line for f in sorted((tmp_path / "r" / name).glob("part-*")) for line in f.read_text().splitlines()]
    assert lines("per_sample") == ["sample_id\tpwm_mae\tzz", "1\t\t2.000000", "2\t0.500000\t1.000000"]
    assert lines("summary") == ["metric\tmean\tstd\tn", "pwm_mae\t0.500000\t0.000000\t1", "zz\t1.500000\t0.500000\t2"]


def test_missing_manifest_column_is_refused(spark, tmp_path):
    p = tmp_path / "bad.tsv"
    p.write_text("sample_id\tsplit\nx\ty\n")
    with pytest.raises(ValueError, match="missing columns"):
        SM.read_source_manifest(spark, str(p))


def test_fold_lists(spark, tmp_path):
    (tmp_path / "train0.txt").write_text("6OD5_A_ITF2_HUMAN.H11MO.0.C.npz\n# note\n\n1abc_B_MA0001.1.jaspar.npz")
    (tmp_path / "id.txt").write_text("2xyz_C_MA0002.2.jaspar.npz")
    parsed = N.parse_fold_entries(SM.read_fold_entries(spark, str(tmp_path))).orderBy("split", "ord").collect()
    assert [(r.split, r.structure_id, r.chain, r.motif_id) for r in parsed] == [
        ("id", "2xyz", "C", "MA0002.2.jaspar"), ("train0", "6od5", "A", "ITF2_HUMAN.H11MO.0.C"), ("train0", "1abc", "B", "MA0001.1.jaspar")]


def test_pwm_text_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("m", 0, 0.1, 0.2, 0.3, 0.4), ("m", 1, 0.4, 0.3, 0.2, 0.1)], "motif_id string, pos int, a double, c double, g double, t double")
    out = str(tmp_path / "pwm")
    K.write_pwm_text(rows, out)
    whole = read_whole(spark, out + "/motif_id=m").select(F.lit("m").alias("motif_id"), "text")
    back = SMo.scan_pwm_text(number_lines(whole)).orderBy("pos").collect()
    assert [round(r.a, 6) for r in back] == [0.1, 0.4]


def test_ordered_attempts(spark):
    rows = spark.createDataFrame([("s", i, "skip" if i in (1, 2) else None, i % 2 == 0) for i in range(10)],
                                 "split string, ord long, skip_reason string, succeeded boolean")
    got = lambda **k: sorted(r.ord for r in N.ordered_attempt_limit(rows, **k).collect())
    assert got(limit=2) == [0, 1, 2, 3, 4]
    assert got(max_attempts=2) == [0, 1, 2, 3]
    assert got() == list(range(10))
    assert got(limit=99) == list(range(10))


def test_status_tables_on_disk(spark, tmp_path):
    status = spark.createDataFrame([(1, "ok", None, 1, 2, 3, 1), (2, "skip", "filtered_low_contact", 0, 0, 0, 0)],
                                   "sample_id long, status string, reason string, A_base_pos long, A_backbone_pos long, A_contact_pos long, site_pos long")
    for c in K.SAMPLE_TABLE:
        if c not in status.columns and c != "processed_path":
            status = status.withColumn(c, F.lit("x"))
    K.write_status(status, str(tmp_path))
    assert spark.read.text(f"{tmp_path}/processed_manifest").collect()[0][0] == f"{tmp_path}/processed/1.parquet"
    failed = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/failed").collect()
    assert [(r.sample_id, r.reason) for r in failed] == [("2", "filtered_low_contact")]


def test_line_numbers_go_through_all_splits(spark, tmp_path):
    """Files of many splits, a short one and an empty one: numbers are dense, in file order, over all files."""
    os.makedirs(tmp_path / "in")
    want = []
    for name, n in (("a.txt", 4000), ("b.txt", 1), ("c.txt", 0), ("d.txt", 2500)):
        lines = [f"{name} line {i} {'x' * (i % 50)}" for i in range(n)]
        (tmp_path / "in" / name).write_text("".join(x + "\n" for x in lines))
        want += lines
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = read_lines(spark, f"{tmp_path}/in/*.txt")
        assert got.rdd.getNumPartitions() > 1
        rows = sorted((r.ord, r.value) for r in got.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r[0] for r in rows] == list(range(len(want))) and [r[1] for r in rows] == want
    entries = SM.scan_fold_entries(got).collect()
    assert len(entries) == len(want) and all(isinstance(e.ord, int) for e in entries)


LOOP = "data_x\nloop_\n_atom_site.group_PDB\n_atom_site.auth_atom_id\n_atom_site.auth_comp_id\n_atom_site.auth_asym_id\n_atom_site.auth_seq_id\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\n"


@pytest.mark.parametrize("token", ["C" * 1_000_000, "'" + "a b" * 300_000 + "'", 'a"b c"' * 200_000, "''" * 500_000 + "z", "' " * 500_000])
def test_a_token_of_any_length_is_read(spark, token):
    """Tokens of a megabyte, quoted, bare and mixed; the rows beside them stay."""
    text = LOOP + "ATOM CA GLY A 1 1 2 3\nATOM CB GLY A 2 4 5 6\n#\n" + "loop_\n_other.value\n" + token + "\n"
    blank = "data_x\nloop_" + " \n" * 400_000 + LOOP[len("data_x\nloop_"):] + "ATOM CA GLY A 1 1 2 3\n"
    long = LOOP + f"ATOM {token} GLY A 1 1 2 3\nATOM CB GLY A 2 4 5 6\n"
    start = time.monotonic()
    got = SS.scan_mmcif_atoms(spark.createDataFrame([("s", text), ("b", blank), ("l", long)], "structure_id string, text string")).collect()
    assert time.monotonic() - start < 60
    assert sorted((r.name, r.resseq) for r in got if r.structure_id == "s") == [("CA", 1), ("CB", 2)]
    assert [(r.name, r.resseq) for r in got if r.structure_id == "b"] == [("CA", 1)]
    if token != "' " * 500_000:  # many blank tokens make rows of their own
        assert sorted(r.resseq for r in got if r.structure_id == "l") == [1, 2] and max(len(r.name) for r in got) == max(2, len(re.sub("[\"']", "", token)))
