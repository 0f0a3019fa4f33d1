"""Manifests, fold lists and motif indices on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions.constants import MANIFEST_COLUMNS, MANIFEST_REQUIRED, MOTIF_INDEX_COLUMNS
from helixframe.operators.manifest import infer_split, resolve
from helixframe.sources.text import list_items, read_lines


def missing_columns(have: list[str], required: list[str]) -> list[str]:
    return sorted(set(required) - set(have))


def parse_tsv(lines: DataFrame, header: list[str], required: list[str], what: str) -> DataFrame:
    """Tab-separated ``value`` lines (header excluded) as trimmed string columns."""
    lost = missing_columns(header, required)
    if lost:
        raise ValueError(f"{what} is missing columns: {', '.join(lost)}")
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    row = F.from_csv("value", schema, {"sep": "\t", "escape": '"', "quote": '"'})
    return lines.where(F.trim("value") != "").select(
        *[c for c in lines.columns if c != "value"],
        *[F.trim(F.coalesce(row[f"c{i}"], F.lit(""))).alias(c) for i, c in enumerate(header)])


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"no header: {path}")
    return first[0].split("\t")


def read_tsv(spark: SparkSession, path: str, required: list[str], what: str) -> DataFrame:
    """TSV file with ``ord`` = file order; only the header line comes to the driver."""
    header = _header(spark, path)
    lines = read_lines(spark, path).where(F.col("value") != "\t".join(header)).drop("path")
    return parse_tsv(lines, header, required, what)


def read_source_manifest(spark: SparkSession, path: str) -> DataFrame:
    df = read_tsv(spark, path, MANIFEST_REQUIRED, "source manifest")
    if df.isEmpty():
        raise ValueError(f"source manifest has no rows: {path}")
    for c in MANIFEST_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.select("ord", *MANIFEST_COLUMNS)


def read_motif_index(spark: SparkSession, path: str) -> DataFrame:
    df = read_tsv(spark, path, MOTIF_INDEX_COLUMNS, "motif index").select("ord", *MOTIF_INDEX_COLUMNS)
    if df.isEmpty():
        raise ValueError(f"motif index has no rows: {path}")
    return df


def scan_path_manifest(lines: DataFrame, root: str, limit: int = 0) -> DataFrame:
    """List of paths (path, ord, value): comments skipped, relative ones joined to
    ``root``; the first ``limit`` in file order."""
    items = list_items(lines).select("ord", resolve(F.col("item"), root).alias("sample_path"))
    return items.orderBy("ord").limit(limit) if limit else items


def scan_fold_entries(lines: DataFrame) -> DataFrame:
    """Fold lists: split from the file name, one entry per line."""
    return list_items(lines).select(infer_split(F.col("path")).alias("split"), "ord", F.col("item").alias("entry"))


def read_fold_entries(spark: SparkSession, *paths: str) -> DataFrame:
    return scan_fold_entries(read_lines(spark, *paths))


MANIFEST_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST_COLUMNS])
