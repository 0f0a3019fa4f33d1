"""Queries on manifests and fold lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import manifest as N
from helixframe.plans import views as V
from helixframe.plans.common import table, with_ctes


def _valid(spark, sf):
    return N.validate_manifest(V.manifest_rows(spark, sf))


def _parsed(spark, sf):
    return N.parse_fold_entries(V.fold_lines(spark, sf))


def _index(spark, sf):
    return N.latest_motif_index(V.motif_index(spark, sf))


def validate_manifest(spark, sf):
    return _valid(spark, sf).select("ord", "sample_id", "structure_id", "motif_id", "motif_path", "error")


def normalize_structure_format(spark, sf):
    m = V.manifest_rows(spark, sf)
    return m.select("ord", "structure_format", N.normalize_structure_format(F.col("structure_format")).alias("normalized"))


def infer_structure_format(spark, sf):
    """Page addresses without query and fragment, with a structure suffix by key."""
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    suffix = F.get(F.array(*[F.lit(x) for x in ["", ".pdb", ".CIF", ".mmcif", ".txt"]]), (k % 5).cast("int"))
    path = F.concat(F.regexp_replace("url", r"[?#].*$", ""), suffix)
    return p.select("page_id", path.alias("path"), N.infer_structure_format(path, "pdb").alias("structure_format"))


def resolve_paths(spark, sf):
    ok = _valid(spark, sf).where("error IS NULL")
    return N.resolve_paths(ok, "/work/meta", "/work/cache").select("ord", "structure_file", "motif_file")


def filter_split_limit(spark, sf):
    return N.filter_split_limit(V.fold_lines(spark, sf), "id", 150)


def parse_fold_entry(spark, sf):
    lines = V.fold_lines(spark, sf)
    # Entries with a folder in front, without the suffix, and unparsable ones.
    k = F.col("ord")
    entry = (F.when(k % 9 == 1, F.concat(F.lit("data/x/"), "entry")).when(k % 9 == 2, F.regexp_replace("entry", r"\.npz$", ""))
             .when(k % 9 == 3, F.concat(F.lit("bad"), k.cast("string"), F.lit("_A.npz"))).otherwise(F.col("entry")))
    return N.parse_fold_entries(lines.withColumn("entry", entry)).drop("split")


def infer_split(spark, sf):
    paths = V.fold_lines(spark, sf).select(F.concat(F.lit("/r/folds/"), "split", F.lit(".txt")).alias("path"))
    return paths.groupBy(N.infer_split(F.col("path")).alias("split")).agg(F.count("*").alias("n"))


def import_fold_manifest(spark, sf):
    return N.import_fold_manifest(_parsed(spark, sf), _index(spark, sf), "mmcif", "/work/cache", "")


def missing_motifs(spark, sf):
    return N.missing_motifs(_parsed(spark, sf), _index(spark, sf)).groupBy("motif_id").agg(
        F.count("*").alias("n_entries"), F.min("ord").alias("first_ord"))


def classify_motif_source(spark, sf):
    ids = _parsed(spark, sf).select(
        F.when(F.col("ord") % 50 == 1, F.regexp_replace("motif_id", "^(MA|TF)", "UN"))
        .when(F.col("ord") % 50 == 2, "plain").otherwise(F.col("motif_id")).alias("motif_id")).distinct()
    return N.classify_motif_source(ids)


def requested_motif_ids(spark, sf):
    p = _parsed(spark, sf)
    curated = p.select("motif_id")
    some = N.requested_motif_ids(p.where("split = 'id'").select("motif_id"), curated)
    none = N.requested_motif_ids(p.where("split = 'nowhere'").select("motif_id"), curated)
    return some.withColumn("request", F.lit("id")).unionByName(none.withColumn("request", F.lit("none")))


def all_pool_dedup(spark, sf):
    return N.all_pool(_parsed(spark, sf))


def resource_counts(spark, sf):
    return N.resource_counts(_parsed(spark, sf))


def multi_char_chain_filter(spark, sf):
    return N.multi_char_chain_filter(_parsed(spark, sf)).select("split", "ord", "chain", "skip_reason")


def ordered_attempt_limit(spark, sf):
    rows = N.multi_char_chain_filter(_parsed(spark, sf)).withColumn("succeeded", F.length("structure_id") % 2 == 0)
    return N.ordered_attempt_limit(rows, 40, 60).select("split", "ord", "skip_reason", "succeeded")


def _outputs(spark, sf):
    return table(spark, sf, "labels").select(F.concat(F.lit("smp"), F.col("doc_id").cast("string")).alias("sample_id"))


def pending_samples(spark, sf):
    return N.pending_samples(_valid(spark, sf).where("error IS NULL").select("ord", "sample_id"), _outputs(spark, sf))


def require_inputs(spark, sf):
    ok = N.resolve_paths(_valid(spark, sf).where("error IS NULL"), "/work/meta", "/work/cache")
    # Files exist for labelled documents only.
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("ord"))
    both = ok.join(lab, "ord", "left_semi")
    files = both.select(F.col("structure_file").alias("path")).unionByName(
        both.where("ord % 10 <> 3").select(F.col("motif_file").alias("path")))
    return N.require_inputs(ok, files).select("ord", "input_error")


def split_rebuild(spark, sf):
    p = _parsed(spark, sf)
    named = p.withColumn("sample_id", F.concat_ws("_", "structure_id", "chain", "motif_id"))
    made = named.where("split LIKE 'train%'").select("sample_id")
    have, lack = N.split_rebuild(p, made)
    return have.withColumn("state", F.lit("written")).unionByName(lack.withColumn("state", F.lit("missing"))).select(
        "split", "ord", "sample_id", "state")


QUERIES = {
    "validate_manifest": validate_manifest, "normalize_structure_format": normalize_structure_format,
    "infer_structure_format": infer_structure_format, "resolve_paths": resolve_paths, "filter_split_limit": filter_split_limit,
    "parse_fold_entry": parse_fold_entry, "infer_split": infer_split, "import_fold_manifest": import_fold_manifest,
    "missing_motifs": missing_motifs, "classify_motif_source": classify_motif_source, "requested_motif_ids": requested_motif_ids,
    "all_pool_dedup": all_pool_dedup, "resource_counts": resource_counts, "multi_char_chain_filter": multi_char_chain_filter,
    "ordered_attempt_limit": ordered_attempt_limit, "pending_samples": pending_samples, "require_inputs": require_inputs,
    "split_rebuild": split_rebuild,
}

MAN = [V.SQL_MANIFEST, """v_val AS (SELECT ord, trim(sample_id) AS sample_id, split, structure_id, structure_path, motif_id, motif_path,
    CASE WHEN structure_format = 'xyz' THEN NULL WHEN structure_format = 'pdbx' THEN 'cif' WHEN structure_format = '.PDB' THEN 'pdb' ELSE structure_format END AS fmt,
    CASE WHEN trim(sample_id) = '' THEN 'source manifest row has empty sample_id' WHEN structure_id = '' THEN trim(sample_id) || ': empty structure_id'
      WHEN motif_id = '' THEN trim(sample_id) || ': empty motif_id' WHEN motif_path = '' THEN trim(sample_id) || ': empty motif_path'
      WHEN structure_format = 'xyz' THEN 'Unsupported structure_format=''xyz''. Use one of: cif, mmcif, pdb.' END AS error FROM v_man)""",
       """v_path AS (SELECT ord, sample_id, CASE WHEN structure_path = '' THEN '/work/cache/' || lower(structure_id) || CASE WHEN fmt = 'pdb' THEN '.pdb' ELSE '.cif' END
      WHEN structure_path LIKE '/%' THEN structure_path ELSE '/work/meta/' || structure_path END AS structure_file,
    CASE WHEN motif_path LIKE '/%' THEN motif_path ELSE '/work/meta/' || motif_path END AS motif_file FROM v_val WHERE error IS NULL)"""]
FOLD = [V.SQL_FOLDS]
IDX = [V.SQL_FOLDS, V.SQL_INDEX, """v_last AS (SELECT motif_id, motif_source, motif_version, motif_path FROM v_index WHERE motif_id <> ''
    QUALIFY row_number() OVER (PARTITION BY motif_id ORDER BY ord DESC) = 1)"""]

ORACLES = {
    "validate_manifest": with_ctes(MAN, "SELECT ord, sample_id, structure_id, motif_id, motif_path, error FROM v_val"),
    "normalize_structure_format": with_ctes(MAN, "SELECT m.ord, structure_format, fmt AS normalized FROM v_man m JOIN v_val USING (ord)"),
    "infer_structure_format": """SELECT page_id, path, CASE WHEN regexp_matches(lower(path), '[^/]\\.pdb$') THEN 'pdb' WHEN regexp_matches(lower(path), '[^/]\\.(mm)?cif$') THEN 'mmcif' ELSE 'pdb' END AS structure_format
        FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['', '.pdb', '.CIF', '.mmcif', '.txt'][page_id % 5 + 1] AS path FROM pages)""",
    "resolve_paths": with_ctes(MAN, "SELECT ord, structure_file, motif_file FROM v_path"),
    "filter_split_limit": with_ctes(FOLD, "SELECT split, ord, entry FROM v_folds WHERE split = 'id' ORDER BY ord LIMIT 150"),
    "parse_fold_entry": with_ctes(FOLD, """SELECT ord, CASE ord % 9 WHEN 1 THEN 'data/x/' || entry WHEN 2 THEN replace(entry, '.npz', '') WHEN 3 THEN 'bad' || ord || '_A.npz' ELSE entry END AS entry,
        CASE WHEN ord % 9 <> 3 THEN structure_id END AS structure_id, CASE WHEN ord % 9 <> 3 THEN chain END AS chain, CASE WHEN ord % 9 <> 3 THEN motif_id END AS motif_id,
        CASE WHEN ord % 9 = 3 THEN 'Cannot parse fold entry: bad' || ord || '_A.npz' END AS entry_error FROM v_folds"""),
    "infer_split": with_ctes(FOLD, "SELECT split, count(*) AS n FROM v_folds GROUP BY ALL"),
    "import_fold_manifest": with_ctes(IDX, """SELECT ord, structure_id || '_' || chain || '_' || motif_id AS sample_id, split, structure_id, '/work/cache/' || structure_id || '.cif' AS structure_path,
        'mmcif' AS structure_format, chain AS protein_chains, '' AS dna_chains, motif_id, motif_source, motif_version, motif_path,
        'imported_from=' || split || '.txt;motif_source=untrimmed_motif_index' AS notes FROM v_folds JOIN v_last USING (motif_id)"""),
    "missing_motifs": with_ctes(IDX, "SELECT motif_id, count(*) AS n_entries, min(ord) AS first_ord FROM v_folds WHERE motif_id NOT IN (SELECT motif_id FROM v_last) GROUP BY ALL"),
    "classify_motif_source": with_ctes(FOLD, """SELECT motif_id, CASE WHEN j THEN 'JASPAR' WHEN s IS NOT NULL THEN 'HOCOMOCO' END AS motif_source,
        CASE WHEN j AND motif_id LIKE 'UN%' THEN 'JASPAR2022-unvalidated-untrimmed' WHEN j THEN replace(motif_id, '.jaspar', '') || '-untrimmed' WHEN s IS NOT NULL THEN 'v11-full-untrimmed' END AS motif_version,
        CASE WHEN j AND motif_id LIKE 'UN%' THEN 'UNVALIDATED' WHEN j THEN 'CORE' ELSE s END AS collection,
        CASE WHEN NOT j AND s IS NULL THEN 'Cannot infer HOCOMOCO species for motif id: ' || motif_id END AS error
        FROM (SELECT *, motif_id LIKE '%.jaspar' AS j, CASE WHEN contains(motif_id, '_HUMAN.') THEN 'HUMAN' WHEN contains(motif_id, '_MOUSE.') THEN 'MOUSE' END AS s
          FROM (SELECT DISTINCT CASE ord % 50 WHEN 1 THEN 'UN' || substr(motif_id, 3) WHEN 2 THEN 'plain' ELSE motif_id END AS motif_id FROM v_folds))"""),
    "requested_motif_ids": with_ctes(FOLD, "SELECT DISTINCT motif_id, 'id' AS request FROM v_folds WHERE split = 'id' UNION ALL SELECT DISTINCT motif_id, 'none' FROM v_folds"),
    "all_pool_dedup": with_ctes(FOLD, "SELECT DISTINCT structure_id, chain, motif_id FROM v_folds"),
    "resource_counts": with_ctes(FOLD, """SELECT 'fold_entries' AS field, count(*) AS value FROM v_folds UNION ALL SELECT 'unique_samples', count(DISTINCT structure_id || '_' || chain || '_' || motif_id) FROM v_folds
        UNION ALL SELECT 'unique_pdb', count(DISTINCT structure_id) FROM v_folds UNION ALL SELECT 'unique_pwm', count(DISTINCT motif_id) FROM v_folds"""),
    "multi_char_chain_filter": with_ctes(FOLD, "SELECT split, ord, chain, CASE WHEN length(chain) <> 1 THEN 'skip_multi_char_chain' END AS skip_reason FROM v_folds"),
    "ordered_attempt_limit": with_ctes(FOLD, """SELECT split, ord, skip_reason, succeeded FROM (SELECT *, coalesce(sum(att) OVER w, 0) AS pa, coalesce(sum(att * succeeded::INT) OVER w, 0) AS ps FROM (
        SELECT split, ord, CASE WHEN length(chain) <> 1 THEN 'skip_multi_char_chain' END AS skip_reason, length(structure_id) % 2 = 0 AS succeeded, (length(chain) = 1)::INT AS att FROM v_folds)
        WINDOW w AS (PARTITION BY split ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE pa < 60 AND ps < 40"""),
    "pending_samples": with_ctes(MAN, "SELECT ord, sample_id FROM v_val WHERE error IS NULL AND sample_id NOT IN (SELECT 'smp' || doc_id FROM labels)"),
    "require_inputs": with_ctes(MAN, """SELECT ord, CASE WHEN structure_file NOT IN (SELECT structure_file FROM v_path WHERE ord IN (SELECT doc_id FROM labels)) AND structure_file NOT IN (SELECT motif_file FROM v_path WHERE ord % 10 <> 3 AND ord IN (SELECT doc_id FROM labels))
          THEN 'structure file not found: ' || structure_file
        WHEN motif_file NOT IN (SELECT motif_file FROM v_path WHERE ord % 10 <> 3 AND ord IN (SELECT doc_id FROM labels)) THEN 'motif file not found: ' || motif_file END AS input_error FROM v_path"""),
    "split_rebuild": with_ctes(FOLD, """SELECT split, ord, s AS sample_id, CASE WHEN s IN (SELECT structure_id || '_' || chain || '_' || motif_id FROM v_folds WHERE split LIKE 'train%') THEN 'written' ELSE 'missing' END AS state
        FROM (SELECT *, structure_id || '_' || chain || '_' || motif_id AS s FROM v_folds)"""),
}
