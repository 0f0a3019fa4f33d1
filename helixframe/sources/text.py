"""Text files as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.checkpoints import cut_lineage


def read_whole(spark: SparkSession, *paths: str) -> DataFrame:
    """path, text: one row per file.  For formats whose records span lines; such
    files (structures, motifs) are bounded in size and there are many of them."""
    return spark.read.text(list(paths), wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def number_lines(texts: DataFrame) -> DataFrame:
    """Rows of ``text`` as one row per line with ``line_no``."""
    return texts.select(
        *[c for c in texts.columns if c != "text"],
        F.posexplode(F.split("text", "\r?\n")).alias("line_no", "value"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, ord, value for line lists of any size. ``ord``: 0, 1, 2 ... through all lines, file by file in path order.

    Spark splits the files. The lines are written once with their split and row, so that the splits cannot change;
    lines are then counted by split - a row for each split - and the counts before a split are added to its rows."""
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")]
    lines = cut_lineage(spark.read.text(list(paths)).select(*split, F.monotonically_increasing_id().alias("row"), "value"))
    splits = lines.groupBy("path", "block").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(splits, ["path", "block"]).select("path", (F.col("row") + F.col("_shift")).alias("ord"), "value")


def list_items(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and # comments."""
    item = F.trim("value")
    return lines.withColumn("item", item).where((item != "") & ~item.startswith("#")).drop("value")
