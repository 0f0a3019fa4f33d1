"""Stored samples: named arrays per sample, and the long rows behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PWM_NAMES = ("pwm", "PWM", "pwm_target", "P")


def pack_samples(cells: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row per sample (or per ``keys``) with one array per value column,
    ordered by (res_idx, slot); ``res_idx`` and ``slot`` become arrays too."""
    keys = keys or ["sample_id"]
    fields = ["res_idx", "slot", *values]
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_c"))
    return packed.select(*keys, *[F.col(f"_c.{f}").alias(f) for f in fields])


def unpack_samples(packed: DataFrame, values: list[str], keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["sample_id"]
    fields = ["res_idx", "slot", *values]
    zipped = F.arrays_zip(*[F.col(f) for f in fields])
    return packed.select(*keys, F.explode(zipped).alias("_c")).select(*keys, *[F.col(f"_c.{f}").alias(f) for f in fields])


def _ones_like(col: str, value: int) -> Column:
    return F.transform(F.col(col), lambda x: F.lit(value))


def legacy_sample_defaults(packed: DataFrame) -> DataFrame:
    """Fill what old samples lack.  Arrays: base_label (or a_label), base_mask,
    backbone_label, contact_label, and pwm_mask beside pwm."""
    d = packed.withColumn("base_label", F.coalesce("base_label", "a_label"))
    d = d.withColumn("base_mask", F.coalesce("base_mask", _ones_like("base_label", 1)))
    d = d.withColumn("backbone_label", F.coalesce("backbone_label", _ones_like("base_label", 0)))
    union = F.zip_with("base_label", "backbone_label", lambda x, y: F.greatest(x, y))
    return d.withColumn("contact_label", F.coalesce("contact_label", union)).withColumn(
        "pwm_mask", F.coalesce("pwm_mask", _ones_like("pwm", 1)))


def first_pwm_column(df: DataFrame, names: tuple[str, ...] = PWM_NAMES) -> DataFrame:
    """``motif``: the first of the named ARRAY<ARRAY<DOUBLE>> columns that is [M,4]."""
    usable = [F.when(F.forall(F.col(n), lambda r: F.size(r) == 4), F.col(n)) for n in names]
    return df.withColumn("motif", F.coalesce(*usable))
