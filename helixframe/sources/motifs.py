"""Motif text files: row-per-position matrices and base-per-row collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.pwm import ACGT, settled
from helixframe.operators.motif import base_row_checks, base_rows_to_pwm, normalize_pwm
from helixframe.sources.text import number_lines, read_whole

_FLOAT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"
_NUMBER = r"([-+]?(?:\d*\.\d+|\d+)(?:[eE][-+]?\d+)?)"


def _floats(line: Column) -> Column:
    parts = F.split(F.translate(line, "[],", "   "), r"\s+")
    return F.transform(F.filter(parts, lambda x: x.rlike(_FLOAT)), lambda x: x.cast("double"))


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)), lambda x: x.cast("double"))


def scan_pwm_text(lines: DataFrame) -> DataFrame:
    """motif_id, line_no, value -> normalised rows (motif_id, pos, a, c, g, t).

    A line with at least four numbers gives its last four; headers and comments are
    skipped; in a MEME matrix the first shorter line after its rows ends the motif.
    """
    given = lines.select("motif_id", "line_no", F.explode(F.array(F.trim("value"))).alias("_line"))  # a value may cost more than its scan
    line = F.col("_line")
    skip = (line == "") | line.startswith("#") | line.startswith(">") | line.rlike(r"^[acgtACGT\s]+$")
    head = F.lower(line).startswith("letter-probability matrix")
    nums = F.when(head, F.array().cast("array<double>")).otherwise(_floats(line))
    d = settled(given.where(~skip | head), ["motif_id", "line_no"], {"meme": head, "nums": nums})
    d = d.withColumn("is_row", F.size("nums") >= 4)
    upto = Window.partitionBy("motif_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_meme", F.max("meme").over(upto)).withColumn("_rows", F.sum(F.col("is_row").cast("int")).over(upto))
    d = d.withColumn("_end", F.max(~F.col("is_row") & ~F.col("meme") & F.col("_meme") & (F.col("_rows") > 0)).over(upto))
    rows = d.where(F.col("is_row") & ~F.col("_end"))
    last = F.slice("nums", -4, 4)
    return normalize_pwm(rows.select(
        "motif_id", (F.col("_rows") - 1).cast("int").alias("pos"), *[F.get(last, F.lit(k)).alias(b) for k, b in enumerate(ACGT)]))


def collection_records(texts: DataFrame) -> DataFrame:
    """path, text -> path, motif_id, body: one row per ``>`` record, the last record
    of a repeated id winning.  Records are cut inside the text row: no ordering
    window over the file is needed."""
    recs = texts.select("path", F.posexplode(F.split("text", r"(?m)^[ \t]*>")).alias("rec", "body")).where("rec > 0")
    named = recs.withColumn("motif_id", F.regexp_extract("body", r"^\s*(\S+)", 1))
    return named.groupBy("path", "motif_id").agg(F.max_by("body", "rec").alias("body"))


def _record_lines(texts: DataFrame) -> DataFrame:
    lines = collection_records(texts).select("path", "motif_id", F.posexplode(F.split("body", "\r?\n")).alias("ord", "value"))
    return lines.where((F.col("ord") > 0) & (F.trim("value") != "")).withColumn("value", F.trim("value"))


def jaspar_base_rows(texts: DataFrame) -> DataFrame:
    """Base rows of ``A [ 1 2 ]`` records."""
    base = F.upper(F.substring("value", 1, 1))
    rest = F.substring(F.col("value"), F.lit(2), F.length("value"))
    return _record_lines(texts).where(base.isin("A", "C", "G", "T")).select(
        "path", "motif_id", "ord", base.alias("base"), _numbers(rest).alias("values"))


def scan_jaspar_collection(texts: DataFrame) -> DataFrame:
    """path, motif_id and matrix rows: a motif id in several files is several motifs."""
    return base_rows_to_pwm(jaspar_base_rows(texts))


def hocomoco_base_rows(texts: DataFrame) -> DataFrame:
    """Base rows of records with unlabelled rows; ``n_rows`` shows faulty ones."""
    per = _record_lines(texts).groupBy("path", "motif_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "value"))).getField("value").alias("rows"))
    return per.select("path", "motif_id", F.size("rows").alias("n_rows"), F.posexplode("rows").alias("ord", "value")).select(
        "path", "motif_id", "n_rows", "ord", F.get(F.array(*[F.lit(b.upper()) for b in ACGT]), F.col("ord")).alias("base"),
        _numbers(F.col("value")).alias("values"))


def scan_hocomoco_collection(texts: DataFrame) -> DataFrame:
    """path, motif_id and matrix rows, as ``scan_jaspar_collection``."""
    return base_rows_to_pwm(hocomoco_base_rows(texts).where("n_rows = 4"))


def hocomoco_errors(texts: DataFrame) -> DataFrame:
    """path, motif_id, error: a motif id that is faulty in two files has an error in each."""
    rows = hocomoco_base_rows(texts)
    count = rows.where("n_rows <> 4").select("path", "motif_id", F.concat(
        "motif_id", F.lit(": expected 4 base rows, got "), F.col("n_rows").cast("string")).alias("error")).distinct()
    return count.unionByName(base_row_checks(rows.where("n_rows = 4")).where("error IS NOT NULL").select("path", "motif_id", "error"))


def read_pwm_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One motif per file; motif_id = file name without ``.txt``."""
    whole = read_whole(spark, *paths)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.txt$", "")
    return scan_pwm_text(number_lines(whole.select(stem.alias("motif_id"), "text")))
