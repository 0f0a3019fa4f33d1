"""Text renderings and writers of result tables.

``render_*`` gives the lines as a DataFrame; ``write_*`` stores them with Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.constants import MANIFEST_COLUMNS, MOTIF_INDEX_COLUMNS
from helixframe.functions.pwm import ACGT
from helixframe.operators.manifest import display_path, resolve
from helixframe.operators.motif import normalize_pwm
from helixframe.operators.prepare import COUNTS, Prepared

SAMPLE_TABLE = ["sample_id", "split", "structure_id", "structure_path", "motif_id", "motif_source", "motif_version",
                "motif_path", "protein_chains", "dna_chains", "processed_path", *COUNTS]


def tsv_line(cols: Sequence[str]) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols])


def render_pwm_text(rows: DataFrame) -> DataFrame:
    """motif_id, line_no, value: header and one 8-decimal line per position."""
    body = normalize_pwm(rows).select(
        "motif_id", (F.col("pos") + 1).alias("line_no"),
        F.concat_ws("\t", *[F.format_string("%.8f", F.col(b)) for b in ACGT]).alias("value"))
    head = rows.select("motif_id").distinct().select("motif_id", F.lit(0).alias("line_no"), F.lit("A C G T").alias("value"))
    return body.unionByName(head)


def write_pwm_text(rows: DataFrame, path: str) -> None:
    """One directory per motif, lines in order (a motif's lines share a task)."""
    (render_pwm_text(rows).repartition("motif_id").sortWithinPartitions("motif_id", "line_no")
     .drop("line_no").write.mode("overwrite").partitionBy("motif_id").text(path))


def manifest_for_output(manifest: DataFrame, manifest_dir: str, out_dir: str) -> DataFrame:
    """Fixed columns; paths below ``out_dir`` shown relative to it."""
    shown = lambda c: F.when(F.col(c) == "", "").otherwise(display_path(resolve(F.col(c), manifest_dir), out_dir))
    return manifest.select("ord", *[
        shown(c).alias(c) if c in ("structure_path", "motif_path") else F.col(c) for c in MANIFEST_COLUMNS])


def motif_index_for_output(index: DataFrame, index_dir: str) -> DataFrame:
    return index.select("motif_id", "motif_source", "motif_version",
                        display_path(F.col("motif_path"), index_dir).alias("motif_path")).orderBy("motif_id")


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Tab-separated part files with header; ``order`` sorts by range, in parallel.

    Blank cells stay blank; a quoted cell doubles its quote signs, as ``read_tsv`` expects."""
    out = df.orderBy(*order) if order else df
    out.drop("ord").write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_source_manifest(manifest: DataFrame, path: str, manifest_dir: str) -> None:
    write_tsv(manifest_for_output(manifest, manifest_dir, path), path, ["ord"])


def write_motif_index(index: DataFrame, path: str) -> None:
    write_tsv(motif_index_for_output(index, path).select(*MOTIF_INDEX_COLUMNS), path)


def sample_table(status: DataFrame, out_root: str) -> DataFrame:
    """Rows of the success table. ``processed_path``: the file that holds the sample's arrays as the store names it, shown
    from ``out_root`` on if it lies there; for a status that no store made, the place of a file of the sample's own."""
    if "processed_path" in status.columns:
        path = display_path(F.regexp_replace("processed_path", "^file:/+", "/"), out_root)
    else:
        path = F.concat(F.lit(out_root.rstrip("/") + "/processed/"), F.col("sample_id").cast("string"), F.lit(".parquet"))
    return status.where("status = 'ok'").withColumn("processed_path", path).select(*SAMPLE_TABLE)


def failed_table(status: DataFrame) -> DataFrame:
    return status.where("status <> 'ok'").select("sample_id", "reason")


def write_status(status: DataFrame, out_root: str) -> None:
    """Success table, failure table and list of outputs from one stored status
    table, so that the preparation runs once."""
    root = out_root.rstrip("/")
    status.write.mode("overwrite").parquet(f"{root}/status")
    stored = status.sparkSession.read.parquet(f"{root}/status")
    ok = sample_table(stored, root)
    write_tsv(ok, f"{root}/sample_table")
    write_tsv(failed_table(stored), f"{root}/failed")
    ok.select("processed_path").distinct().write.mode("overwrite").text(f"{root}/processed_manifest")


def write_prepared(prepared: Prepared, out_root: str) -> None:
    """Tables of ``write_status`` and, under ``labels``, the slots of each sample that passed."""
    root = out_root.rstrip("/")
    write_status(prepared.status, root)
    labels = prepared.labels(prepared.status.sparkSession.read.parquet(f"{root}/status"))
    labels.write.mode("overwrite").partitionBy(*[c for c in ("split",) if c in labels.columns]).parquet(f"{root}/labels")


def write_samples(packed: DataFrame, path: str) -> None:
    """Sample arrays as Parquet by split, so that a split is read alone."""
    packed.write.mode("overwrite").partitionBy("split").parquet(path)


def metric_cell(name: str) -> Column:
    v = F.col(f"`{name}`").cast("double")
    return F.when(v.isNull(), "").otherwise(F.format_string("%.6f", v))


def ordered_metrics(names: Sequence[str]) -> list[str]:
    from helixframe.functions.constants import METRIC_ORDER

    known = [m for m in METRIC_ORDER if m in names]
    return known + sorted(set(names) - set(known))


def render_eval_rows(rows: DataFrame, metrics: Sequence[str], ids: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Per-sample lines: ids, then metrics in preferred order, 6 decimals."""
    cols = [F.col(i).cast("string") for i in ids] + [metric_cell(m) for m in ordered_metrics(metrics)]
    return rows.select(*ids, F.concat_ws("\t", *cols).alias("line"))


def render_summary(summary: DataFrame) -> DataFrame:
    return summary.select("metric", F.concat_ws(
        "\t", "metric", F.format_string("%.6f", "mean"), F.format_string("%.6f", "std"), F.col("n").cast("string")).alias("line"))


def summary_json(summary: DataFrame) -> DataFrame:
    """One JSON object per metric (JSON lines keep the report splittable)."""
    return summary.select("metric", F.to_json(F.struct("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")).alias("json"))


def write_eval_report(rows: DataFrame, summary: DataFrame, metrics: Sequence[str], path: str) -> None:
    """Lines with a header, samples by id and metrics in their fixed order, beside JSON lines of both."""
    root = path.rstrip("/")

    def put(lines: DataFrame, order: Sequence[Column | str], header: Sequence[str], name: str) -> None:
        first = lines.sparkSession.createDataFrame([("\t".join(header),)], "line string").withColumn("_head", F.lit(0))
        both = lines.withColumn("_head", F.lit(1)).unionByName(first, allowMissingColumns=True)
        both.orderBy("_head", *order).select("line").write.mode("overwrite").text(f"{root}/{name}")

    names = ordered_metrics(metrics)
    put(render_eval_rows(rows, metrics), ["sample_id"], ["sample_id", *names], "per_sample")
    place = F.array_position(F.array(*[F.lit(m) for m in ordered_metrics([*names])]), F.col("metric"))
    put(render_summary(summary), [place, "metric"], ["metric", "mean", "std", "n"], "summary")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{root}/samples_json")
    summary_json(summary).select("json").write.mode("overwrite").text(f"{root}/summary_json")
