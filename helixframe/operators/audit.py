"""Audits of splits, duplicates and method comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import connected
from helixframe.operators.metrics import long_metrics, summarize_metrics
from helixframe.operators.ordering import running_totals

LEVELS = {
    "id": ["structure_id"],
    "id_motif": ["structure_id", "motif_id"],
    "motif": ["motif_id"],
}


def _group_sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("split", "structure_id", "motif_id").agg(F.count(F.lit(1)).alias("n"))


def duplicate_weight_audit(entries: DataFrame) -> DataFrame:
    """Per split: entries, structures, structure+motif groups and how many hold
    several entries.  Each level is counted from the one below it."""
    pairs = _group_sizes(entries)
    ids = pairs.groupBy("split", "structure_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("n") > 1).alias("multi_pairs"))
    return ids.groupBy("split").agg(
        F.sum("n").alias("n_entry"), F.count(F.lit(1)).alias("n_pdb"), F.sum("n_pairs").alias("n_pdb_pwm"),
        F.count_if(F.col("n") > 1).alias("multi_pdb_groups"), F.sum("multi_pairs").alias("multi_pdb_pwm_groups"))


def duplicate_details(entries: DataFrame) -> DataFrame:
    """Entries of every structure+motif group that holds more than one."""
    many = _group_sizes(entries).where(F.col("n") > 1)
    return entries.join(many, ["split", "structure_id", "motif_id"])


def leakage_audit(entries: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Shared groups of each listed pair of splits at every level.

    Each group is reduced to one flag per named split, so no pairs are formed
    inside a group.
    """
    names = sorted({s for p in pairs for s in p})
    flag = {s: f"_f{i}" for i, s in enumerate(names)}
    keyed = entries.select("split", F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.concat_ws("|", *cols).alias("key")) for level, cols in LEVELS.items()
    ])).alias("k")).select("split", "k.level", "k.key")
    groups = keyed.groupBy("level", "key").agg(*[
        F.max((F.col("split") == s).cast("int")).alias(flag[s]) for s in names])
    counts = groups.groupBy("level").agg(*[
        F.sum(F.col(flag[a]) * F.col(flag[b])).alias(f"{a}|{b}") for a, b in pairs])
    long = counts.unpivot(["level"], [f"{a}|{b}" for a, b in pairs], "pair", "shared")
    parts = F.split("pair", r"\|")
    return long.select("level", F.get(parts, F.lit(0)).alias("left_split"), F.get(parts, F.lit(1)).alias("right_split"), "shared")


def dedup_coverage(entries: DataFrame, valid: DataFrame) -> DataFrame:
    """Benchmark size per split at each level, for all and for prepared entries.

    ``valid``: split, structure_id, chain, motif_id of prepared samples."""
    ok = valid.select("split", "structure_id", "chain", "motif_id").distinct().withColumn("_ok", F.lit(1))
    j = entries.join(ok, ["split", "structure_id", "chain", "motif_id"], "left")
    pairs = j.groupBy("split", "structure_id", "motif_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_ok", F.lit(0))).alias("v"))
    ids = pairs.groupBy("split", "structure_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("p"), F.sum("v").alias("v"),
        F.count_if(F.col("v") > 0).alias("vp"))
    return ids.groupBy("split").agg(
        F.sum("n").alias("raw_entries"), F.sum("p").alias("pdb_pwm"), F.count(F.lit(1)).alias("pdb"),
        F.sum("v").alias("valid_entries"), F.sum("vp").alias("valid_pdb_pwm"), F.count_if(F.col("v") > 0).alias("valid_pdb"))


def group_mean_metric(rows: DataFrame, metrics: Sequence[str], group: str = "grp") -> DataFrame:
    """Mean within each group, then mean, std and n over groups."""
    per = long_metrics(rows, [group], metrics).groupBy(group, "metric").agg(F.avg("value").alias("value"))
    return per.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_groups"))


def best_contact_pick(rows: DataFrame, rule: str = "A_contact_pos", group: str = "grp") -> DataFrame:
    """One row per group: the largest ``rule`` (A_contact_pos or A_base_pos), or the
    ``first``; ties go to the smallest sample_id.  A plain aggregate, no sort."""
    order = -F.col("sample_id") if rule == "first" else F.struct(F.col(rule), -F.col("sample_id"))
    keep = F.struct(*[c for c in rows.columns if c != group])
    return rows.groupBy(group).agg(F.max_by(keep, order).alias("r")).select(group, "r.*")


def group_weights(entries: DataFrame) -> DataFrame:
    """weight = 1 / size of the entry's (split, structure, motif) group."""
    return entries.join(_group_sizes(entries), ["split", "structure_id", "motif_id"]).withColumn(
        "weight", 1.0 / F.col("n")).drop("n")


def common_samples(rows: DataFrame, methods: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Keys that every method has."""
    have = rows.where(F.col("method").isin(list(methods))).select(key, "method").distinct()
    return have.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(methods)).select(key)


def same_subset_compare(
    rows: DataFrame, methods: Sequence[str], metrics: Sequence[str], key: str = "sample_id"
) -> DataFrame:
    """Summary of several methods on the samples they share."""
    shared = rows.where(F.col("method").isin(list(methods))).join(common_samples(rows, methods, key), key, "left_semi")
    return summarize_metrics(shared, metrics, ["method"])


def better_count(rows: DataFrame, a: str, b: str, metric: str, key: str = "sample_id") -> DataFrame:
    """How often method ``b`` has the lower value than ``a`` on shared keys."""
    pick = lambda m: F.avg(F.when(F.col("method") == m, F.col(metric)))
    wide = rows.where(F.col("method").isin(a, b)).groupBy(key).agg(pick(a).alias("va"), pick(b).alias("vb"))
    both = wide.where(F.col("va").isNotNull() & F.col("vb").isNotNull())
    return both.agg(
        F.count_if(F.col("vb") < F.col("va")).alias("better"), F.count_if(F.col("vb") == F.col("va")).alias("equal"),
        F.count(F.lit(1)).alias("n"))


def median_metric(rows: DataFrame, metric: str, by: Sequence[str] = ("method",)) -> DataFrame:
    """Exact median per group from the running counts of distinct values: a value that
    many rows share is one row here, and no group is held in one task."""
    by = list(by)
    vals = rows.where(F.col(metric).isNotNull()).groupBy(*by, F.col(metric).alias("v")).agg(F.count(F.lit(1)).alias("one"))
    r = running_totals(vals, by, [F.col("v").asc()], {"upto": "one"})
    sizes = vals.groupBy(*by).agg(F.sum("one").alias("n"))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    holds = lambda k: (F.col("upto") >= k) & (F.col("upto") - F.col("one") < k)
    mid = r.join(sizes, by).where(holds(low) | holds(high))
    return mid.groupBy(*by).agg(F.avg("v").alias("median"), F.max("n").alias("n"))


def fold_metric_variance(rows: DataFrame, metrics: Sequence[str], fold: Column) -> DataFrame:
    """Per metric and fold: fold mean, beside the ensemble mean and the variance of
    the fold means."""
    long = long_metrics(rows.withColumn("fold", fold), ["fold"], metrics)
    folds = long.groupBy("metric", "fold").agg(
        F.avg("value").alias("fold_mean"), F.sum("value").alias("_s"), F.count("value").alias("n"))
    over = folds.groupBy("metric").agg(
        F.var_pop("fold_mean").alias("variance"), (F.sum("_s") / F.sum("n")).alias("ensemble_mean"))
    return folds.drop("_s").join(over, "metric")


def leave_group_split(entries: DataFrame, level: str, k: int) -> DataFrame:
    """``bucket`` in 0..k-1 from the md5 of the group key: whole groups stay together
    and the assignment needs no shuffle."""
    key = F.concat_ws("|", *LEVELS[level])
    number = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return entries.withColumn("bucket", F.pmod(number, F.lit(k)))


def leave_component_split(entries: DataFrame, k: int, levels: Sequence[str] = ("structure_id", "motif_id")) -> DataFrame:
    """``bucket`` in 0..k-1 such that no value of any level is in two buckets, beside ``component`` and its ``n`` entries.

    Entries that share a structure or a motif, directly or over others, form a component of the graph of their values;
    components are whole in a bucket.  They fill the buckets by size, the largest first: a bucket holds a k-th of the
    entries and one component more at most.  One component alone cannot be cut: then its bucket is larger."""
    name = lambda c: F.concat(F.lit(f"{c}:"), F.coalesce(c, F.lit("")))
    pairs = None
    for other in levels[1:] or levels[:1]:
        one = entries.select(name(levels[0]).alias("a"), name(other).alias("b"))
        pairs = one if pairs is None else pairs.unionByName(one)
    labels = connected(pairs.distinct())
    named = entries.withColumn("node", name(levels[0])).join(labels, "node").drop("node")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    filled = running_totals(sizes, [], [F.col("n").desc(), F.col("component")], {"upto": "n"}, totals={"all": "n"})
    # Where a component's middle comes to lie in the row of all entries.
    place = F.floor((F.col("upto") * 2 - F.col("n")) * k / (F.col("all") * 2))
    return named.join(filled.select("component", "n", F.least(place, F.lit(k - 1)).cast("int").alias("bucket")), "component")
