"""Motif metrics, ranking metrics, threshold sweeps and their summaries.

Motif pairs: sample_id, pos, target ``a,c,g,t`` and prediction ``p_a,p_c,p_g,p_t``.
Binary rows: key columns, ``row_id``, ``y_true`` (0/1), ``score``.  Rows are ranked by
score descending, then row_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.checkpoints import cut_lineage
from helixframe.functions.constants import GLOBAL_NAMES, METRIC_ORDER
from helixframe.functions.pwm import ACGT, normalized, row_ic, row_kl, row_l1, total
from helixframe.operators.ordering import running_totals


# -------------------------------------------------------------- motif metrics
def _pair_rows(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = normalized([F.col(b) for b in ACGT])
    p = normalized([F.col(f"p_{b}") for b in ACGT])
    return pairs.select(
        *keys, "pos", *[c.alias(b) for b, c in zip(ACGT, t)], *[c.alias(f"p_{b}") for b, c in zip(ACGT, p)])


def _t() -> list[Column]:
    return [F.col(b) for b in ACGT]


def _p() -> list[Column]:
    return [F.col(f"p_{b}") for b in ACGT]


def pwm_mae(pairs: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    return _pair_rows(pairs, keys).groupBy(*keys).agg(F.avg(row_l1(_t(), _p())).alias("mae"))


def pwm_kl(pairs: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    return _pair_rows(pairs, keys).groupBy(*keys).agg(F.avg(row_kl(_t(), _p())).alias("kl"))


def _moments() -> list[Column]:
    """Weighted and plain sums of centred products.  Rows sum to one, so every
    (weighted) mean over the four cells of a row is exactly 1/4."""
    x = [c - 0.25 for c in _t()]
    y = [c - 0.25 for c in _p()]
    ic = row_ic(_t())
    out = [F.max(F.abs(ic)).alias("_w")]
    for name, prod in (
        ("xy", total([i * j for i, j in zip(x, y)])),
        ("xx", total([i * i for i in x])),
        ("yy", total([j * j for j in y])),
    ):
        out += [F.sum(ic * prod).alias(f"_w{name}"), F.sum(prod).alias(f"_u{name}")]
    return out + [F.sum(ic).alias("_sum_ic"), F.count(F.lit(1)).alias("_n")]


def _pcc() -> Column:
    def corr(prefix: str, scale: Column) -> Column:
        vx, vy = F.col(f"{prefix}xx") / scale, F.col(f"{prefix}yy") / scale
        den = F.sqrt(vx * vy)
        return F.when(den > 0, F.col(f"{prefix}xy") / scale / den).otherwise(0.0)

    weighted = corr("_w", F.col("_sum_ic") * 4)
    plain = corr("_u", F.col("_n") * 4.0)
    return F.when(F.col("_w") == 0, plain).otherwise(weighted)


def ic_pcc(pairs: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Pearson correlation over all cells, weighted by the target's information."""
    return _pair_rows(pairs, keys).groupBy(*keys).agg(*_moments()).select(*keys, _pcc().alias("ic_pcc"))


_RC_KL = (
    "aggregate(zip_with(rows, reverse(rows), (x, y) -> "
    "x.a * (ln(x.a) - ln(y.p_t)) + x.c * (ln(x.c) - ln(y.p_g)) + "
    "x.g * (ln(x.g) - ln(y.p_c)) + x.t * (ln(x.t) - ln(y.p_a))), 0D, (s, v) -> s + v) / size(rows)"
)


def pwm_metrics(pairs: DataFrame, keys: Sequence[str] = ("sample_id",), masked: bool = False) -> DataFrame:
    """mae, kl, ic_pcc and rc_aware_kl in one shuffle on ``keys``.

    The positions of one motif travel as an array for the reversed comparison.
    ``masked``: use only rows with ``pwm_mask`` = 1 (by default the mask is ignored).
    """
    if masked:
        pairs = pairs.where("pwm_mask = 1")
    g = _pair_rows(pairs, keys).groupBy(*keys).agg(
        F.avg(row_l1(_t(), _p())).alias("mae"), F.avg(row_kl(_t(), _p())).alias("kl"), *_moments(),
        F.array_sort(F.collect_list(F.struct("pos", *ACGT, *[f"p_{b}" for b in ACGT]))).alias("rows"))
    return g.select(*keys, "mae", "kl", _pcc().alias("ic_pcc"), F.least("kl", F.expr(_RC_KL)).alias("rc_aware_kl"))


def rc_aware_kl(pairs: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    return pwm_metrics(pairs, keys).select(*keys, "rc_aware_kl")


def compare_methods(target: DataFrame, named: dict[str, DataFrame]) -> DataFrame:
    """Metrics of several predictions (sample_id, pos, p_a..p_t) per method and sample."""
    every = None
    for name, pred in named.items():
        one = pred.withColumn("method", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return pwm_metrics(target.join(every, ["sample_id", "pos"]), ["method", "sample_id"])


# ------------------------------------------------------------ ranking metrics
def ranked(rows: DataFrame, keys: Sequence[str], with_total: bool = False) -> DataFrame:
    """Rows with their ``rank`` and ``tp`` (positives up to and including them), and with ``total`` (all of the group's)."""
    df = rows.select(*keys, "row_id", F.col("y_true").cast("bigint").alias("y_true"), "score")
    return running_totals(df, keys, [F.col("score").desc(), F.col("row_id").asc()], {"tp": "y_true"}, totals={"total": "y_true"} if with_total else None)


def _ap() -> Column:
    hit = F.sum(F.col("tp") / F.col("rank") * F.col("y_true"))
    return F.coalesce(F.try_divide(hit, F.sum("y_true")), F.lit(0.0))


def average_precision(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ranked(rows, keys).groupBy(*keys).agg(_ap().alias("ap"))


def map_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ap, top_l_precision and top_l (= positives) per group; zeros without positives."""
    first = F.sum(F.when(F.col("rank") <= F.col("total"), F.col("y_true")))
    return ranked(rows, keys, True).groupBy(*keys).agg(
        _ap().alias("ap"), F.coalesce(F.try_divide(first, F.max("total")), F.lit(0.0)).alias("top_l_precision"),
        F.max("total").cast("double").alias("top_l"))


def top_l_precision(rows: DataFrame, keys: Sequence[str], top_l: int | None = None) -> DataFrame:
    """Precision among the first L rows of each group, 1 <= L <= group size; L is
    the number of positives unless given."""
    want = F.col("total") if top_l is None else F.lit(top_l)
    return ranked(rows, keys, True).where(F.col("rank") <= F.greatest(F.lit(1), want)).groupBy(*keys).agg(
        F.avg("y_true").alias("top_l_precision"))


def _f1_mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> tuple[Column, Column]:
    d = [c.cast("double") for c in (tp, fp, fn, tn)]
    tp, fp, fn, tn = d
    precision = tp / F.greatest(tp + fp, F.lit(1.0))
    recall = tp / F.greatest(tp + fn, F.lit(1.0))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return f1, F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0)


def confusion(rows: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    yes = F.col("score") >= threshold
    pos = F.col("y_true") == 1
    return rows.groupBy(*keys).agg(
        F.count_if(pos & yes).alias("tp"), F.count_if(~pos & yes).alias("fp"),
        F.count_if(pos & ~yes).alias("fn"), F.count_if(~pos & ~yes).alias("tn"))


def binary_metrics(rows: DataFrame, keys: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """ap, f1 and mcc per group."""
    f1, mcc = _f1_mcc(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    c = confusion(rows, keys, threshold).withColumn("f1", f1).withColumn("mcc", mcc)
    return c.join(average_precision(rows, keys), list(keys))


def best_threshold(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sweep of all distinct scores and 0.5 in one sort.

    Among thresholds whose value lies within 1e-8 + 1e-5*max of the maximum, the
    one nearest to 0.5 wins, then the smaller.
    """
    keys = list(keys)
    hist = rows.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("pos"))
    groups = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1).select()
    half = groups.select(*keys, F.lit(0.5).alias("score"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("pos"))
    points = hist.unionByName(half).groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    cum = running_totals(points, keys, [F.col("score").desc()], {"n": "n", "pos": "pos"}, totals={"_n": "n", "_pos": "pos"})
    return _sweep(cum, keys)


def _sweep(cum: DataFrame, keys: list[str]) -> DataFrame:
    """``cum``: score, rows ``n`` and positives ``pos`` at or above it, and of the whole group (``_n``, ``_pos``)."""
    tp, fp = F.col("pos"), F.col("n") - F.col("pos")
    fn, neg = F.col("_pos") - F.col("pos"), F.col("_n") - F.col("_pos")
    f1, mcc = _f1_mcc(tp, fp, fn, neg - fp)
    swept = cum.select(*keys, "score", f1.alias("f1"), mcc.alias("mcc"))
    top = swept.groupBy(*keys).agg(F.max("f1").alias("best_f1"), F.max("mcc").alias("best_mcc"))
    close = lambda v, m: F.col(v) >= F.col(m) - (F.lit(1e-8) + F.lit(1e-5) * F.abs(F.col(m)))
    near = F.struct(F.abs(F.col("score") - 0.5), F.col("score"))
    return _with_group(swept, top, keys).groupBy(*keys).agg(
        F.max(F.when(F.col("score") == 0.5, F.col("f1"))).alias("f1_at_0.5"),
        F.max(F.when(F.col("score") == 0.5, F.col("mcc"))).alias("mcc_at_0.5"),
        F.max("best_f1").alias("best_f1_diagnostic"),
        F.min_by("score", F.when(close("f1", "best_f1"), near)).alias("best_f1_threshold_diagnostic"),
        F.max("best_mcc").alias("best_mcc_diagnostic"),
        F.min_by("score", F.when(close("mcc", "best_mcc"), near)).alias("best_mcc_threshold_diagnostic"))


def _with_group(rows: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Join group values back; without keys they are one row, read as a scalar."""
    if keys:
        return rows.join(per_group, keys)
    quoted = lambda df: [F.col(f"`{c}`") for c in df.columns]
    packed = per_group.select(F.struct(*quoted(per_group)).alias("_v"))
    return rows.withColumn("_g", packed.scalar()).select(*quoted(rows), "_g.*")


def global_site_summary(rows: DataFrame) -> DataFrame:
    """Pooled metrics over all rows as (metric, mean, std, n); average precision and sweep come from one scan."""
    r = ranked(rows, [])
    sums = r.agg(_ap().alias("ap"), F.count(F.lit(1)).alias("_n"), F.sum("y_true").alias("_pos"), *[
        F.coalesce(F.max(F.when(F.col("score") >= 0.5, F.col(c))), F.lit(0)).alias(f"_{c}") for c in ("rank", "tp")])
    sums = cut_lineage(sums)
    # The last row of a score has what lies at or above it; 0.5 is a threshold too.
    points = r.groupBy("score").agg(F.max("rank").alias("n"), F.max("tp").alias("pos"))
    half = sums.select(F.lit(0.5).alias("score"), F.col("_rank").alias("n"), F.col("_tp").alias("pos"))
    points = points.where("score <> 0.5").unionByName(half)
    sweep = _sweep(_with_group(points, sums.select("_n", "_pos"), []), [])
    wide = _with_group(sweep, sums.select("ap", F.col("_n").alias("n")), [])
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"`{c}`").alias("mean")) for c, name in GLOBAL_NAMES.items()])
    return wide.where("n > 0").select("n", F.explode(pairs).alias("m")).select("m.metric", "m.mean", F.lit(0.0).alias("std"), "n")


# ------------------------------------------------------------------- summaries
def metric_order(metric: Column) -> Column:
    """Sort key: the preferred metrics in their order, the rest after them."""
    ranks = F.create_map(*[x for i, m in enumerate(METRIC_ORDER) for x in (F.lit(m), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, metric), F.lit(len(METRIC_ORDER)))


def long_metrics(rows: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    doubles = rows.select(*ids, *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics])
    long = doubles.unpivot(list(ids), list(metrics), "metric", "value")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    return long.where(finite)


def summarize_metrics(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """mean, population std and n of every metric over its finite values."""
    return long_metrics(rows, by, metrics).groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))


# ----------------------------------------------------------------- evaluation
MAPS = {"A_base": ("base_label", "a_base", "base_mask"),
        "A_backbone": ("backbone_label", "a_backbone", "pwm_mask"),
        "A_contact": ("contact_label", "a_contact", "pwm_mask")}


def masked_map_metrics(cells: DataFrame, label: str, score: str, mask: str | None) -> DataFrame:
    """``cells``: sample_id, res_idx, slot and the named columns; only cells with
    mask 1 count, and a slot mask counts for all residues of the slot."""
    kept = cells if mask is None else cells.where(F.col(mask) == 1)
    rows = kept.select("sample_id", F.struct("res_idx", "slot").alias("row_id"),
                       F.col(label).alias("y_true"), F.col(score).alias("score"))
    return map_metrics(rows, ["sample_id"])


def evaluate_pair(cells: DataFrame, sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """One wide row for every sample that any input names.

    A metric of a part that the sample does not have is NULL; 0.0 stands for a map that
    is there without positives.  ``cells``: sample_id, res_idx, slot, labels, masks and scores of ``MAPS``;
    ``sites``: sample_id, res_idx, site_label, site_prob; ``pairs``: motif pairs.
    The three maps and the site ranking share one ranking pass.
    """
    options = [
        F.struct(F.lit(p).alias("kind"), F.col(label).alias("y_true"), F.col(score).alias("score"),
                 (F.col(mask) == 1).alias("use"))
        for p, (label, score, mask) in MAPS.items()]
    maps = cells.select("sample_id", F.struct(F.col("res_idx").cast("int"), F.col("slot").cast("int")).alias("row_id"),
                        F.explode(F.array(*options)).alias("o")).where("o.use").select(
        "sample_id", "o.kind", "row_id", "o.y_true", "o.score")
    site_rows = sites.select(
        "sample_id", F.lit("site").alias("kind"),
        F.struct(F.col("res_idx").cast("int"), F.lit(0)).alias("row_id"),
        F.col("site_label").alias("y_true"), F.col("site_prob").alias("score"))
    rows = maps.union(site_rows)
    m = map_metrics(rows, ["sample_id", "kind"])
    wide = m.groupBy("sample_id").agg(*[
        F.max(F.when(F.col("kind") == p, F.col(v))).alias(f"{p}_{v}")
        for p in MAPS for v in ("ap", "top_l_precision", "top_l")
    ], F.max(F.when(F.col("kind") == "site", F.col("ap"))).alias("site_ap"))
    f1, mcc = _f1_mcc(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    site = confusion(site_rows, ["sample_id"]).select("sample_id", f1.alias("site_f1"), mcc.alias("site_mcc"))
    sizes = sites.groupBy("sample_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_residue"), F.sum("site_label").cast("double").alias("site_pos"))
    totals = cells.groupBy("sample_id").agg(*[
        F.sum(label).cast("double").alias(f"{p}_pos") for p, (label, _, _) in MAPS.items()])
    pwm = pwm_metrics(pairs)
    for c in ("mae", "kl", "ic_pcc", "rc_aware_kl"):
        pwm = pwm.withColumnRenamed(c, f"pwm_{c}")
    every = sizes.select("sample_id").union(totals.select("sample_id")).union(pwm.select("sample_id")).distinct()
    out = every
    for part in (sizes, totals, pwm, wide, site):
        out = out.join(part, "sample_id", "left")
    zero = lambda p, v: F.when(F.col(f"{p}_pos").isNotNull(), F.coalesce(f"{p}_{v}", F.lit(0.0)))
    return out.withColumns({f"{p}_{v}": zero(p, v) for p in MAPS for v in ("ap", "top_l_precision", "top_l")})


def evaluate_manifest(cells: DataFrame, sites: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-sample rows and the summary with the pooled rows appended."""
    rows = evaluate_pair(cells, sites, pairs)
    names = [c for c in rows.columns if c != "sample_id"]
    pooled = global_site_summary(sites.select(
        F.struct("sample_id", "res_idx").alias("row_id"), F.col("site_label").alias("y_true"), F.col("site_prob").alias("score")))
    return rows, summarize_metrics(rows, names).unionByName(pooled)


def pair_predictions(targets: DataFrame, predictions: DataFrame, suffix: str = ".pred.npz") -> DataFrame:
    """Match target paths to prediction paths by stem; a missing one is an error row."""
    stem = F.regexp_extract("target_path", r"([^/]+?)(\.[^./]*)?$", 1)
    base = F.regexp_extract("pred_path", r"([^/]+)$", 1)
    preds = predictions.where(base.endswith(suffix)).select(
        "pred_path", F.expr(f"substring(regexp_extract(pred_path, '([^/]+)$', 1), 1, "
                            f"length(regexp_extract(pred_path, '([^/]+)$', 1)) - {len(suffix)})").alias("stem"))
    return targets.withColumn("stem", stem).join(preds, "stem", "left").withColumn(
        "error", F.when(F.col("pred_path").isNull(), F.concat(F.lit("Missing prediction "), "stem", F.lit(suffix))))
