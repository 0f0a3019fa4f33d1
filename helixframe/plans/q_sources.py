"""Queries that render table rows as text, parse them back and write reports.

The text stands for many small files (one per vector, or twenty records per
collection), so nothing collects more than one file's lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.constants import MANIFEST_COLUMNS, MOTIF_INDEX_COLUMNS
from helixframe.operators import manifest as N
from helixframe.operators import metrics as M
from helixframe.plans import q_prepare as QP
from helixframe.plans import views as V
from helixframe.plans.common import big, r6, table, with_ctes
from helixframe.sources import manifests as SM
from helixframe.sources import motifs as SMo
from helixframe.sources import sinks as K
from helixframe.sources import structures as SS

ATOM_OUT = ["structure_id", "record", "name", "resname", "chain", "resseq", "icode", "element"]


def _raw(spark, sf):
    """Raw atoms with their vector number r and atom number j."""
    a = V.raw_atoms(spark, sf)
    return a.withColumn("r", F.expr("atom_ord div 21")).withColumn("j", F.expr("atom_ord % 21")).withColumn(
        "structure_id", F.concat(F.lit("v"), F.expr("atom_ord div 21").cast("string")))


def pdb_lines(spark, sf):
    a = _raw(spark, sf)
    alt = F.when(F.col("j") % 7 == 3, "A").when(F.col("j") % 7 == 5, "B").otherwise(" ")
    full = F.format_string(
        "%-6s%5d %-4s%s%3s %s%4d%s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s",
        F.col("record"), F.col("atom_ord") % 100000, F.col("name"), alt, F.col("resname"),
        F.when(F.col("r") % 13 == 4, " ").otherwise(F.col("chain")), F.col("resseq") % 10000,
        F.when(F.col("icode") == "", " ").otherwise(F.col("icode")), F.col("x"), F.col("y"), F.col("z"),
        F.lit(1.0), F.lit(20.0), F.col("element"))
    # explode keeps the optimizer from repeating the formatting in every column cut.
    atom = a.select("structure_id", "r", (F.col("j") + 1).alias("line_no"), F.explode(F.array(full)).alias("full")).select(
        "structure_id", "line_no", F.when(F.col("r") % 5 == 0, F.rtrim("full")).otherwise(F.col("full")).alias("value"))
    head = table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("structure_id"),
        F.explode(F.array(F.struct(F.lit(0).alias("line_no"), F.lit("REMARK ATOM records follow").alias("value")),
                          F.struct(F.lit(99).alias("line_no"), F.lit("TER").alias("value")))).alias("h"))
    return atom.unionByName(head.select("structure_id", "h.line_no", "h.value"))


def mmcif_texts(spark, sf):
    """One text per vector: other loops around, quotes, comments, wrapped rows."""
    a = _raw(spark, sf)
    r, j = F.col("r"), F.col("j")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    none = F.lit("?")
    name = F.when(F.col("name").contains("'"), q(F.col("name"))).otherwise(F.col("name"))
    num = lambda c: F.format_string("%.3f", F.col(c))
    row = F.concat_ws(
        " ", F.col("record"), (j + 1).cast("string"), F.when(F.col("element") == "", "?").otherwise(F.col("element")), name,
        F.when(j % 7 == 3, "A").when(j % 7 == 5, "B").otherwise("."), F.lower("resname"),
        F.when(r % 13 == 4, ".").otherwise(F.col("chain")), F.when((r % 13 == 4) | (r % 3 == 1), none).otherwise(F.col("chain")),
        F.when((r % 10 == 3) & (j == 19), "x").otherwise("7"),
        F.when((r % 10 == 3) & (j == 19), ".").otherwise(F.col("resseq").cast("string")),
        F.when(F.col("icode") == "", "?").otherwise(F.col("icode")),
        F.concat(F.when((r % 6 == 2) & (j % 4 == 1), "\n").otherwise(""), F.when((r % 10 == 4) & (j == 18), "abc").otherwise(num("x"))),
        num("y"), num("z"), F.when(r % 4 == 0, none).otherwise(F.col("resname")), F.when(r % 4 == 1, ".").otherwise(name))
    line = F.concat(row, F.when(j % 5 == 0, " # note").otherwise(""), F.when(j == 9, "\n# a comment line\n").otherwise(""))
    tags = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "label_asym_id", "auth_asym_id",
            "label_seq_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "auth_comp_id", "auth_atom_id"]
    head = ("data_x\n#\n_cell.a 1.0\n_struct.title\n;first line\nloop_\n_atom_site.group_PDB\nATOM\n;\nloop_\n_entity.id\n_entity.type\n"
            "1 'non polymer'\n2 ATOM\nloop_\n" + "".join(f"_atom_site.{t}\n" for t in tags))
    tail = "\n#\n_exptl.method 'X-RAY'\nloop_\n_atom_site_anisotrop.id\nATOM\n"
    per = a.select("structure_id", "j", line.alias("line")).groupBy("structure_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("j", "line"))).getField("line"), "\n").alias("body"))
    return per.select("structure_id", F.concat(F.lit(head), "body", F.lit(tail)).alias("text"))


def _atoms_out(df, ordinal):
    return df.select(*ATOM_OUT, big(ordinal).alias("ord"), r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


def scan_pdb_atoms(spark, sf):
    return _atoms_out(SS.scan_pdb_atoms(pdb_lines(spark, sf)), F.col("atom_ord") - 1)


def scan_mmcif_atoms(spark, sf):
    return _atoms_out(SS.scan_mmcif_atoms(mmcif_texts(spark, sf)), F.col("atom_ord") % (1 << 32))


def scan_structures(spark, sf):
    """Even vectors as PDB files, odd ones as mmCIF files."""
    odd = F.substring(F.col("structure_id"), F.lit(2), F.length("structure_id")).cast("int") % 2 == 1
    pdb = pdb_lines(spark, sf).where(~odd).groupBy("structure_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "value"))).getField("value"), "\n").alias("text"))
    files = pdb.withColumn("path", F.concat(F.lit("/st/"), "structure_id", F.lit(".ent"))).unionByName(
        mmcif_texts(spark, sf).where(odd).withColumn("path", F.concat(F.lit("/st/"), "structure_id", F.lit(".CIF"))))
    atoms = SS.scan_structure_texts(files)
    return atoms.groupBy("structure_id", "chain", "resname").agg(
        F.count("*").alias("n_atoms"), r6(F.sum("x")).alias("sx"), r6(F.sum("y")).alias("sy"), r6(F.sum("z")).alias("sz"),
        F.min("name").alias("first_name"))


def pwm_lines(spark, sf):
    v = V.pwm(spark, sf)
    k = F.col("motif_id") % 4
    nums = [F.format_string("%.8f", F.col(b)) for b in "acgt"]
    prefix = F.when(k == 1, F.format_string("%d [", F.col("pos"))).otherwise("")
    suffix = F.when(k == 1, "]").when(k == 3, " consensus").otherwise("")
    sep = F.when(k == 1, ", ").when(k == 3, " ").otherwise("\t")
    row = F.concat(prefix, nums[0], sep, nums[1], sep, nums[2], sep, nums[3], suffix)
    body = v.select("motif_id", (F.col("pos") + 10).cast("int").alias("line_no"), row.alias("value"))
    extra = lambda n, text: F.struct(F.lit(n).alias("line_no"), F.lit(text).alias("value"))
    heads = F.when(k == 0, F.array(extra(0, "A C G T"))).when(k == 1, F.array(extra(0, "# made 1 2 3 4"), extra(1, ">m 1 2 3 4"))).when(
        k == 2, F.array(extra(0, "MEME version 4"), extra(1, "letter-probability matrix: alength= 4 w= 16 nsites= 2 E= 0"),
                        extra(50, "URL none"), extra(51, "0.1 0.2 0.3 0.4"))).otherwise(F.array(extra(0, ""), extra(40, "end 1 2 3")))
    ids = table(spark, sf, "embeddings").select(F.col("vec_id").alias("motif_id"))
    return body.unionByName(ids.select("motif_id", F.explode(heads).alias("h")).select("motif_id", "h.line_no", "h.value"))


def _motif_out(df):
    return df.select("motif_id", big("pos").alias("pos"), *[r6(b).alias(b) for b in "acgt"])


def scan_pwm_text(spark, sf):
    out = SMo.scan_pwm_text(pwm_lines(spark, sf))
    return out.select("motif_id", big("pos").alias("pos"), *[r6(b, 12).alias(b) for b in "acgt"])


def _collections(spark, sf, labelled):
    """Collections of 20 vectors' motifs; some records repeated or faulty."""
    v = V.motifs(spark, sf)
    m = v.groupBy("motif_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[F.round(F.col(b) * 1000).cast("int").alias(b) for b in "acgt"]))).alias("r"))
    k = F.col("motif_id")
    def rows(upto):
        parts = []
        for b in upto:
            vals = F.array_join(F.col(f"r.{b}").cast("array<string>"), " ")
            parts.append(F.concat(F.lit(f"{b.upper()}  [ "), vals, F.lit(" ]\n")) if labelled else F.concat(vals, F.lit("\n")))
        return F.concat(*parts)
    bad = rows("act") if labelled else rows("acg")
    old = F.when(k % 10 == 3, F.concat(F.lit(">M"), k.cast("string"), F.lit(" old\n"), F.lit("A [ 9 ]\nC [ 9 ]\nG [ 9 ]\nT [ 9 ]\n" if labelled else "9\n9\n9\n9\n"))).otherwise("")
    rec = F.concat(old, F.lit(">M"), k.cast("string"), F.lit("\tNAME\n"), F.when(k % 13 == 5, bad).otherwise(rows("acgt")), F.lit("\n"))
    return m.groupBy(F.concat(F.lit("c"), F.expr("motif_id div 40").cast("string")).alias("path")).agg(
        F.concat(F.lit("junk 1 2 3\n"), F.array_join(F.array_sort(F.collect_list(F.struct(k, rec.alias("t")))).getField("t"), "")).alias("text"))


def scan_jaspar_collection(spark, sf):
    return _motif_out(SMo.scan_jaspar_collection(_collections(spark, sf, True)))


def scan_hocomoco_collection(spark, sf):
    texts = _collections(spark, sf, False)
    rows = _motif_out(SMo.scan_hocomoco_collection(texts)).withColumn("error", F.lit(None).cast("string"))
    return rows.unionByName(SMo.hocomoco_errors(texts).drop("path"), allowMissingColumns=True)


def scan_source_manifest(spark, sf):
    m = V.manifest_rows(spark, sf)
    lines = m.select("ord", K.tsv_line(MANIFEST_COLUMNS).alias("value"))
    return SM.parse_tsv(lines, MANIFEST_COLUMNS, SM.MANIFEST_REQUIRED, "source manifest")


def scan_path_manifest(spark, sf):
    k = F.col("doc_id")
    ks = k.cast("string")
    value = (F.when(k % 7 == 0, "").when(k % 7 == 1, "  # skipped").when(k % 7 == 2, F.concat(F.lit("/abs/"), ks, F.lit(".npz")))
             .otherwise(F.concat(F.lit(" rel/"), ks, F.lit(".npz "))))
    lines = table(spark, sf, "documents").select(k.alias("ord"), value.alias("value"))
    return SM.scan_path_manifest(lines, "/data/sets")


def scan_fold_entries(spark, sf):
    f = V.fold_lines(spark, sf)
    k = F.col("ord")
    lines = f.select(F.concat(F.lit("file:/folds/"), "split", F.lit(".txt")).alias("path"), "ord",
                     F.when(k % 11 == 4, "# comment").when(k % 11 == 5, "   ").otherwise(F.concat(F.lit(" "), "entry")).alias("value"))
    return SM.scan_fold_entries(lines)


def scan_motif_index(spark, sf):
    lines = V.motif_index(spark, sf).select("ord", K.tsv_line(MOTIF_INDEX_COLUMNS).alias("value"))
    return N.latest_motif_index(SM.parse_tsv(lines, MOTIF_INDEX_COLUMNS, MOTIF_INDEX_COLUMNS, "motif index"))


# ------------------------------------------------------------------------ sinks
def sink_pwm_text(spark, sf):
    return K.render_pwm_text(V.pwm(spark, sf)).withColumn("line_no", big("line_no"))


def sink_source_manifest(spark, sf):
    ok = N.validate_manifest(V.manifest_rows(spark, sf)).where("error IS NULL")
    out = K.manifest_for_output(ok, "/data/sets", "/data")
    return out.select("ord", K.tsv_line(MANIFEST_COLUMNS).alias("line"))


def sink_motif_index(spark, sf):
    idx = N.latest_motif_index(V.motif_index(spark, sf)).withColumn("motif_path", N.resolve(F.col("motif_path"), "/data/idx"))
    return K.motif_index_for_output(idx, "/data").select("motif_id", K.tsv_line(MOTIF_INDEX_COLUMNS).alias("line"))


def _status(spark, sf):
    return QP.status_rows(spark, sf)


def sink_failed_table(spark, sf):
    return K.failed_table(_status(spark, sf)).select("sample_id", K.tsv_line(["sample_id", "reason"]).alias("line"))


def sink_eval_report(spark, sf):
    rows = V.eval_rows(spark, sf).select("sample_id", "A_contact_pos", (F.col("pwm_mae") * 0.123456789123).alias("pwm_mae"),
                                         (F.col("pwm_kl") * 0.123456789123).alias("pwm_kl"), (F.col("pwm_mae") * 0.3214567891).alias("extra"))
    names = ["extra", "A_contact_pos", "pwm_kl", "pwm_mae"]
    per = K.render_eval_rows(rows, names).select(F.col("sample_id").cast("string").alias("key"), "line")
    summary = K.render_summary(M.summarize_metrics(rows, names)).select(F.col("metric").alias("key"), "line")
    return per.unionByName(summary)


QUERIES = {
    "scan_pdb_atoms": scan_pdb_atoms, "scan_mmcif_atoms": scan_mmcif_atoms, "scan_structures": scan_structures,
    "scan_pwm_text": scan_pwm_text, "scan_jaspar_collection": scan_jaspar_collection,
    "scan_hocomoco_collection": scan_hocomoco_collection, "scan_source_manifest": scan_source_manifest,
    "scan_path_manifest": scan_path_manifest, "scan_fold_entries": scan_fold_entries, "scan_motif_index": scan_motif_index,
    "sink_pwm_text": sink_pwm_text, "sink_source_manifest": sink_source_manifest, "sink_motif_index": sink_motif_index,
    "sink_failed_table": sink_failed_table, "sink_eval_report": sink_eval_report,
}

_XYZ = "round(x, 6) + 0.0::DOUBLE AS x, round(y, 6) + 0.0::DOUBLE AS y, round(z, 6) + 0.0::DOUBLE AS z"
_CH = "CASE WHEN r % 13 = 4 THEN '_' ELSE chain END"
_CIFKEEP = "j % 7 <> 5 AND NOT (r % 10 = 3 AND j = 19) AND NOT (r % 10 = 4 AND j = 18)"
_N4 = ", ".join(f"round({b}, 8) AS {b}" for b in "acgt")
_CNT = ", ".join(f"round({b} * 1000, 0) AS {b}" for b in "acgt")
MOTIF = [V.SQL_PWM, V.SQL_MOTIF]
_STAT = [V.SQL_CONTACT, QP._STATUS]
_T = " || chr(9) || "


def _f6(e):
    return f"format('{{:.6f}}', {e})"


def _sum_line(m, e):
    return f"SELECT '{m}' AS key, '{m}'{_T}{_f6(f'avg({e})')}{_T}{_f6(f'stddev_pop({e})')}{_T}count({e}) AS line FROM v_eval"


ORACLES = {
    "scan_pdb_atoms": with_ctes([V.SQL_ATOMS], f"SELECT 'v' || r AS structure_id, record, name, resname, {_CH} AS chain, (resseq % 10000)::INT AS resseq, icode, element, j AS ord, {_XYZ} FROM v_atoms WHERE j % 7 <> 5"),
    "scan_mmcif_atoms": with_ctes([V.SQL_ATOMS], f"SELECT 'v' || r AS structure_id, record, name, resname, {_CH} AS chain, resseq, icode, element, j AS ord, {_XYZ} FROM v_atoms WHERE {_CIFKEEP}"),
    "scan_structures": with_ctes([V.SQL_ATOMS], f"""SELECT 'v' || r AS structure_id, {_CH} AS chain, resname, count(*) AS n_atoms, round(sum(x), 6) + 0.0::DOUBLE AS sx, round(sum(y), 6) + 0.0::DOUBLE AS sy,
        round(sum(z), 6) + 0.0::DOUBLE AS sz, min(name) AS first_name FROM v_atoms WHERE j % 7 <> 5 AND (r % 2 = 0 OR ({_CIFKEEP})) GROUP BY ALL"""),
    "scan_pwm_text": with_ctes([V.SQL_PWM, f"v8 AS (SELECT motif_id, pos, {_N4} FROM v_pwm)"], "SELECT motif_id, pos, " + ", ".join(f"round({b} / (a+c+g+t), 12) AS {b}" for b in "acgt") + " FROM v8"),
    "scan_jaspar_collection": with_ctes(MOTIF, f"SELECT 'M' || motif_id AS motif_id, pos, {_CNT} FROM v_motif WHERE motif_id % 13 <> 5"),
    "scan_hocomoco_collection": with_ctes(MOTIF, f"""SELECT 'M' || motif_id AS motif_id, pos, {_CNT}, NULL AS error FROM v_motif WHERE motif_id % 13 <> 5
        UNION ALL SELECT DISTINCT 'M' || motif_id, NULL, NULL, NULL, NULL, NULL, 'M' || motif_id || ': expected 4 base rows, got 3' FROM v_motif WHERE motif_id % 13 = 5"""),
    "scan_source_manifest": with_ctes([V.SQL_MANIFEST], "SELECT ord, " + ", ".join(f"trim({c}) AS {c}" for c in MANIFEST_COLUMNS) + " FROM v_man"),
    "scan_path_manifest": "SELECT doc_id AS ord, CASE WHEN doc_id % 7 = 2 THEN '/abs/' || doc_id || '.npz' ELSE '/data/sets/rel/' || doc_id || '.npz' END AS sample_path FROM documents WHERE doc_id % 7 > 1",
    "scan_fold_entries": with_ctes([V.SQL_FOLDS], "SELECT split, ord, entry FROM v_folds WHERE ord % 11 NOT IN (4, 5)"),
    "scan_motif_index": with_ctes([V.SQL_INDEX], """SELECT motif_id, motif_source, motif_version, motif_path FROM v_index WHERE motif_id <> ''
        QUALIFY row_number() OVER (PARTITION BY motif_id ORDER BY ord DESC) = 1"""),
    "sink_pwm_text": with_ctes([V.SQL_PWM], f"SELECT motif_id, pos + 1 AS line_no, {_T.join(chr(102) + 'ormat(' + chr(39) + '{:.8f}' + chr(39) + f', {b})' for b in 'acgt')} AS value FROM v_pwm UNION ALL SELECT DISTINCT motif_id, 0, 'A C G T' FROM v_pwm"),
    "sink_source_manifest": with_ctes([V.SQL_MANIFEST], f"""SELECT ord, trim(sample_id){_T}split{_T}structure_id{_T}
        CASE WHEN structure_path = '' THEN '' WHEN structure_path LIKE '/data/%' THEN substr(structure_path, 7) ELSE 'sets/' || structure_path END{_T}
        CASE structure_format WHEN 'pdbx' THEN 'cif' WHEN '.PDB' THEN 'pdb' ELSE structure_format END{_T}protein_chains{_T}dna_chains{_T}motif_id{_T}motif_source{_T}motif_version{_T}
        CASE WHEN motif_path LIKE '/data/%' THEN substr(motif_path, 7) ELSE 'sets/' || motif_path END{_T}notes AS line FROM v_man
        WHERE trim(sample_id) <> '' AND structure_id <> '' AND motif_id <> '' AND motif_path <> '' AND structure_format <> 'xyz'"""),
    "sink_motif_index": with_ctes([V.SQL_INDEX], f"""SELECT motif_id, motif_id{_T}motif_source{_T}motif_version{_T}'idx/' || motif_path AS line FROM v_index WHERE motif_id <> ''
        QUALIFY row_number() OVER (PARTITION BY motif_id ORDER BY ord DESC) = 1"""),
    "sink_failed_table": with_ctes(_STAT, f"SELECT sample_id, sample_id{_T}CASE WHEN status = 'fail' THEN 'structure file not found: ' || sample_id ELSE 'filtered_low_contact ' || {QP.COUNTS_SQL} END AS line FROM st WHERE status <> 'ok'"),
    "sink_eval_report": with_ctes([V.SQL_EVAL], f"""SELECT sample_id::VARCHAR AS key, sample_id{_T}{_f6('pwm_mae * 0.123456789123::DOUBLE')}{_T}coalesce({_f6('pwm_kl * 0.123456789123::DOUBLE')}, ''){_T}{_f6('A_contact_pos::DOUBLE')}{_T}{_f6('pwm_mae * 0.3214567891::DOUBLE')} AS line FROM v_eval
        UNION ALL {_sum_line('pwm_mae', 'pwm_mae * 0.123456789123::DOUBLE')} UNION ALL {_sum_line('pwm_kl', 'pwm_kl * 0.123456789123::DOUBLE')} UNION ALL {_sum_line('A_contact_pos', 'A_contact_pos')} UNION ALL {_sum_line('extra', 'pwm_mae * 0.3214567891::DOUBLE')}"""),
}
