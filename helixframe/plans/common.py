"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(col: Column | str, digits: int = 6) -> Column:
    """Rounded DOUBLE for output; adds 0.0 so that -0.0 never appears."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def joined(col: Column | str, sep: str = ",") -> Column:
    """An array as text, for outputs compared by value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(c.cast("array<string>"), sep)


def with_ctes(ctes: list[str], body: str) -> str:
    text = "WITH " + ",\n".join(ctes) + "\n" + body
    return text.replace("count_if(", "count(*) FILTER (WHERE ")
