"""Manifests and fold lists as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.constants import MANIFEST_COLUMNS
from helixframe.operators.ordering import first_per_key

FORMATS = ("cif", "mmcif", "pdb")


# ------------------------------------------------------------- column helpers
def normalize_structure_format(value: Column) -> Column:
    """pdb / cif / mmcif, or NULL when the format is not supported."""
    v = F.regexp_replace(F.lower(F.trim(value)), r"^\.+", "")
    v = F.when(v == "pdbx", "cif").otherwise(v)
    return F.when(v.isin(*FORMATS), v)


def infer_structure_format(path: Column, default: str = "mmcif") -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.when(suffix == ".pdb", "pdb").when(suffix.isin(".cif", ".mmcif"), "mmcif").otherwise(default)


def resolve(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def display_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def parse_fold_entries(entries: DataFrame) -> DataFrame:
    """Adds structure_id, chain, motif_id, entry_error of ``path/id_chain_motif.npz``."""
    name = F.substring_index(F.trim("entry"), "/", -1)
    stem = F.when(name.endswith(".npz"), F.substring(name, F.lit(1), F.length(name) - 4)).otherwise(name)
    parts = F.col("_parts")
    good = F.size(parts) == 3
    # A one-element explode makes the parts a column of their own: filters on the
    # results would otherwise be pushed down with a copy of the split in each.
    return entries.select("*", F.explode(F.array(F.split(stem, "_", 3))).alias("_parts")).select(
        *entries.columns,
        F.when(good, F.lower(F.get(parts, F.lit(0)))).alias("structure_id"),
        F.when(good, F.get(parts, F.lit(1))).alias("chain"),
        F.when(good, F.get(parts, F.lit(2))).alias("motif_id"),
        F.when(~good, F.concat(F.lit("Cannot parse fold entry: "), "entry")).alias("entry_error"))


# ------------------------------------------------------------------- manifests
def trim_manifest(rows: DataFrame) -> DataFrame:
    """All twelve columns as trimmed strings; NULL and absent become ''."""
    have = set(rows.columns)
    return rows.select(*[c for c in rows.columns if c not in MANIFEST_COLUMNS], *[
        (F.trim(F.coalesce(F.col(c), F.lit(""))) if c in have else F.lit("")).alias(c) for c in MANIFEST_COLUMNS])


def validate_manifest(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Trimmed rows with ``error`` (first problem of the row, else NULL)."""
    t = trim_manifest(rows)
    sid = F.col("sample_id")
    fmt = normalize_structure_format(F.col("structure_format"))
    empty = lambda c: F.col(c) == ""
    error = (
        F.when(empty("sample_id"), "source manifest row has empty sample_id")
        .when(empty("structure_id"), F.concat(sid, F.lit(": empty structure_id")))
        .when(empty("motif_id"), F.concat(sid, F.lit(": empty motif_id")))
        .when(empty("motif_path"), F.concat(sid, F.lit(": empty motif_path")))
        .when(fmt.isNull(), F.concat(F.lit("Unsupported structure_format='"), F.col("structure_format"),
                                     F.lit("'. Use one of: cif, mmcif, pdb.")))
    )
    out = t.withColumn("error", error).withColumn("structure_format", F.coalesce(fmt, F.col("structure_format")))
    if strict:
        out = out.where(F.assert_true(F.col("error").isNull(), F.col("error")).isNull())
    return out


def resolve_paths(valid: DataFrame, manifest_dir: str, cache_dir: str) -> DataFrame:
    """``structure_file`` and ``motif_file``; a blank structure path points into the
    cache as lower(structure_id) plus the extension of its format."""
    ext = F.when(F.col("structure_format") == "pdb", ".pdb").otherwise(".cif")
    cached = F.concat(F.lit(cache_dir.rstrip("/") + "/"), F.lower("structure_id"), ext)
    return valid.withColumn(
        "structure_file", F.when(F.col("structure_path") == "", cached).otherwise(resolve(F.col("structure_path"), manifest_dir)),
    ).withColumn("motif_file", resolve(F.col("motif_path"), manifest_dir))


def filter_split_limit(rows: DataFrame, split: str | None = None, limit: int = 0) -> DataFrame:
    """Rows of one split; the first ``limit`` of them in file order (0 = all)."""
    out = rows if split is None else rows.where(F.col("split") == split)
    return out.orderBy("ord").limit(limit) if limit else out


def pending_samples(samples: DataFrame, outputs: DataFrame, overwrite: bool = False) -> DataFrame:
    return samples if overwrite else samples.join(outputs.select("sample_id"), "sample_id", "left_anti")


def require_inputs(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """``input_error`` when the structure or the motif file is not in ``files``
    (column ``path``)."""
    f = files.select("path").distinct()
    s = f.select(F.col("path").alias("structure_file"), F.lit(True).alias("_s"))
    m = f.select(F.col("path").alias("motif_file"), F.lit(True).alias("_m"))
    return resolved.join(s, "structure_file", "left").join(m, "motif_file", "left").withColumn(
        "input_error",
        F.when(F.col("_s").isNull(), F.concat(F.lit("structure file not found: "), "structure_file"))
        .when(F.col("_m").isNull(), F.concat(F.lit("motif file not found: "), "motif_file"))).drop("_s", "_m")


# ----------------------------------------------------------------- fold lists
def infer_split(path: Column) -> Column:
    """Split name = file stem."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def latest_motif_index(index: DataFrame) -> DataFrame:
    """Index rows without blank ids; a later duplicate wins (``ord`` = file order)."""
    t = index.withColumn("motif_id", F.trim("motif_id")).where(F.col("motif_id") != "")
    return t.groupBy("motif_id").agg(F.max_by(
        F.struct("motif_source", "motif_version", "motif_path"), F.col("ord")).alias("r")).select("motif_id", "r.*")


def import_fold_manifest(
    parsed: DataFrame, index: DataFrame, structure_format: str = "mmcif", cache_dir: str = "", dna_chains: str = ""
) -> DataFrame:
    """Fold entries joined to the motif index as manifest rows (plus ``ord``)."""
    ext = ".pdb" if structure_format == "pdb" else ".cif"
    where = F.concat(F.lit(cache_dir.rstrip("/") + "/"), "structure_id", F.lit(ext)) if cache_dir else F.lit("")
    j = parsed.where(F.col("entry_error").isNull()).join(index, "motif_id")
    return j.select(
        "ord", F.concat_ws("_", "structure_id", "chain", "motif_id").alias("sample_id"), "split", "structure_id",
        where.alias("structure_path"), F.lit(structure_format).alias("structure_format"),
        F.col("chain").alias("protein_chains"), F.lit(dna_chains).alias("dna_chains"), "motif_id", "motif_source",
        "motif_version", "motif_path",
        F.concat(F.lit("imported_from="), "split", F.lit(".txt;motif_source=untrimmed_motif_index")).alias("notes"))


def missing_motifs(parsed: DataFrame, index: DataFrame) -> DataFrame:
    return parsed.where(F.col("entry_error").isNull()).join(index.select("motif_id"), "motif_id", "left_anti")


def classify_motif_source(ids: DataFrame) -> DataFrame:
    """motif_source, motif_version, collection from the spelling of ``motif_id``."""
    m = F.col("motif_id")
    jaspar = m.endswith(".jaspar")
    matrix = F.regexp_replace(m, r"\.jaspar$", "")
    loose = jaspar & m.startswith("UN")
    species = F.when(m.contains("_HUMAN."), "HUMAN").when(m.contains("_MOUSE."), "MOUSE")
    return ids.withColumn(
        "motif_source", F.when(jaspar, "JASPAR").when(species.isNotNull(), "HOCOMOCO"),
    ).withColumn(
        "motif_version", F.when(loose, "JASPAR2022-unvalidated-untrimmed").when(jaspar, F.concat(matrix, F.lit("-untrimmed")))
        .when(species.isNotNull(), "v11-full-untrimmed"),
    ).withColumn(
        "collection", F.when(loose, "UNVALIDATED").when(jaspar, "CORE").otherwise(species),
    ).withColumn("error", F.when(~jaspar & species.isNull(), F.concat(
        F.lit("Cannot infer HOCOMOCO species for motif id: "), m)))


def requested_motif_ids(requested: DataFrame, curated: DataFrame) -> DataFrame:
    """Sorted distinct requested ids; all curated ids when none is requested."""
    fallback = curated.select("motif_id").where(~requested.exists())
    return requested.select("motif_id").unionByName(fallback).distinct().orderBy("motif_id")


def all_pool(parsed: DataFrame) -> DataFrame:
    """Distinct samples over all folds."""
    return parsed.select("structure_id", "chain", "motif_id").distinct()


def resource_counts(parsed: DataFrame) -> DataFrame:
    """(field, value) rows: entries, unique samples, structures and motifs."""
    per = parsed.groupBy("structure_id", "chain", "motif_id").agg(F.count(F.lit(1)).alias("n"))
    wide = per.agg(
        F.sum("n").alias("fold_entries"), F.count(F.lit(1)).alias("unique_samples"),
        F.countDistinct("structure_id").alias("unique_pdb"), F.countDistinct("motif_id").alias("unique_pwm"))
    return wide.unpivot([], wide.columns, "field", "value")


def multi_char_chain_filter(parsed: DataFrame, allow: bool = False) -> DataFrame:
    """Adds ``skip_reason``; skipped rows stay visible."""
    long = F.length("chain") != 1
    return parsed.withColumn("skip_reason", F.when(long & F.lit(not allow), "skip_multi_char_chain"))


def ordered_attempt_limit(rows: DataFrame, limit: int = 0, max_attempts: int = 0) -> DataFrame:
    """Rows that a serial run per split would reach before it stops.

    ``rows``: split, ord, skip_reason, succeeded.  The run stops before the next
    row once ``limit`` successes or ``max_attempts`` attempts are reached, so the
    last row is the one of the limit-th success or attempt; both cut-offs come from
    a top-N per split, never from a running sum over a whole split.
    """
    tried = rows.where(F.col("skip_reason").isNull())
    out = rows
    for n, source in ((limit, tried.where("succeeded")), (max_attempts, tried)):
        if not n:
            continue
        top = first_per_key(source.select("split", "ord"), ["split"], [F.col("ord")], n)
        cut = top.groupBy("split").agg(F.max("ord").alias("_cut"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n)
        out = out.join(cut.drop("_n"), "split", "left").where(
            F.col("_cut").isNull() | (F.col("ord") <= F.col("_cut"))).drop("_cut")
    return out


def split_rebuild(parsed: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split manifests from one prepared pool, and the entries it lacks.

    ``prepared``: sample_id.  Unless they are few, they are dealt to all shuffle partitions by sample, and so are the entries that
    meet them: rows that compress well would else be put together by their compressed size, and a task that joins them
    sorts them unpacked."""
    named = parsed.withColumn("sample_id", F.concat_ws("_", "structure_id", "chain", "motif_id"))
    n = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pool = prepared.select("sample_id").repartition(n, "sample_id")
    return named.join(pool, "sample_id", "left_semi"), named.join(pool, "sample_id", "left_anti")
