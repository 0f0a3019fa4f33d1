"""Queries of the split and benchmark audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import audit as U
from helixframe.operators import manifest as N
from helixframe.plans import views as V
from helixframe.plans.common import big, r6, with_ctes

PAIRS = [("train0", "valid0"), ("train1", "valid1"), ("train2", "valid2"), ("train3", "valid3"), ("train4", "valid4"),
         ("train0", "id"), ("train1", "id"), ("train2", "id"), ("train3", "id"), ("train4", "id")]
METHODS = ["1-URGENT", "2-HIGH", "5-LOW"]
METRICS = ["pwm_mae", "pwm_kl", "site_ap"]


def _entries(spark, sf):
    return N.parse_fold_entries(V.fold_lines(spark, sf)).drop("entry_error")


def duplicate_weight_audit(spark, sf):
    return U.duplicate_weight_audit(_entries(spark, sf))


def duplicate_details(spark, sf):
    return U.duplicate_details(_entries(spark, sf)).select("split", "structure_id", "motif_id", "entry", "n")


def leakage_audit(spark, sf):
    out = U.leakage_audit(_entries(spark, sf), PAIRS)
    return out.withColumn("shared", big("shared"))


def dedup_coverage(spark, sf):
    e = _entries(spark, sf)
    return U.dedup_coverage(e, e.where("length(chain) = 1"))


def group_mean_metric(spark, sf):
    return U.group_mean_metric(V.eval_rows(spark, sf), METRICS).select("metric", r6("mean").alias("mean"), r6("std").alias("std"), "n_groups")


def best_contact_pick(spark, sf):
    rows = V.eval_rows(spark, sf).select("sample_id", "grp", "A_contact_pos", "A_base_pos")
    out = None
    for rule in ("A_contact_pos", "A_base_pos", "first"):
        one = U.best_contact_pick(rows, rule).withColumn("rule", F.lit(rule))
        out = one if out is None else out.unionByName(one)
    return out


def group_weights(spark, sf):
    return U.group_weights(_entries(spark, sf)).select("split", "ord", r6("weight").alias("weight"))


def _by_group(spark, sf):
    """Per customer and method: mean metrics (one row per key and method)."""
    return V.eval_rows(spark, sf).groupBy("grp", "method").agg(
        F.avg("pwm_mae").alias("pwm_mae"), F.avg("pwm_kl").alias("pwm_kl"),
        F.avg(F.nanvl("site_ap", F.lit(None))).alias("site_ap")).withColumnRenamed("grp", "sample_id")


def same_subset_compare(spark, sf):
    return U.same_subset_compare(_by_group(spark, sf), METHODS, METRICS).select(
        "method", "metric", r6("mean").alias("mean"), r6("std").alias("std"), "n")


def better_count(spark, sf):
    return U.better_count(_by_group(spark, sf), "1-URGENT", "5-LOW", "pwm_mae")


def median_metric(spark, sf):
    return U.median_metric(V.eval_rows(spark, sf), "pwm_kl").select("method", r6("median", 8).alias("median"), "n")


def fold_metric_variance(spark, sf):
    out = U.fold_metric_variance(V.eval_rows(spark, sf), METRICS, F.col("sample_id") % 5)
    return out.select("metric", "fold", "n", *[r6(c).alias(c) for c in ("fold_mean", "variance", "ensemble_mean")])


def leave_group_split(spark, sf):
    e = _entries(spark, sf)
    out = None
    for level in U.LEVELS:
        one = U.leave_group_split(e, level, 5).select("ord", F.lit(level).alias("level"), "bucket")
        out = one if out is None else out.unionByName(one)
    return out


def leave_component_split(spark, sf):
    """Buckets that share neither a structure nor a motif."""
    out = U.leave_component_split(_entries(spark, sf), 5)
    return out.select("ord", "component", big("n").alias("n"), big("bucket").alias("bucket"))


QUERIES = {
    "leave_component_split": leave_component_split, "duplicate_weight_audit": duplicate_weight_audit, "duplicate_details": duplicate_details, "leakage_audit": leakage_audit,
    "dedup_coverage": dedup_coverage, "group_mean_metric": group_mean_metric, "best_contact_pick": best_contact_pick,
    "group_weights": group_weights, "same_subset_compare": same_subset_compare, "better_count": better_count,
    "median_metric": median_metric, "fold_metric_variance": fold_metric_variance, "leave_group_split": leave_group_split,
}

FOLD = [V.SQL_FOLDS]
EVAL = [V.SQL_EVAL]
_PAIRS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") p(left_split, right_split)"
_KEYS = "kk AS (SELECT DISTINCT split, level, key FROM (SELECT split, unnest(['id', 'id_motif', 'motif']) AS level, unnest([structure_id, structure_id || '|' || motif_id, motif_id]) AS key FROM v_folds))"
_FIN = "isfinite({m}::DOUBLE)"
_BYG = "bg AS (SELECT grp AS sample_id, method, avg(pwm_mae) AS pwm_mae, avg(pwm_kl) AS pwm_kl, avg(site_ap) FILTER (WHERE isfinite(site_ap)) AS site_ap FROM v_eval GROUP BY ALL)"
_M3 = "', '".join(METHODS)


def _each(template: str) -> str:
    return " UNION ALL ".join(template.replace("{m}", m) for m in METRICS)


ORACLES = {
    "duplicate_weight_audit": with_ctes(FOLD, """SELECT split, count(*) AS n_entry, count(DISTINCT structure_id) AS n_pdb, count(DISTINCT structure_id || '|' || motif_id) AS n_pdb_pwm,
        (SELECT count(*) FROM (SELECT 1 FROM v_folds g WHERE g.split = f.split GROUP BY structure_id HAVING count(*) > 1)) AS multi_pdb_groups,
        (SELECT count(*) FROM (SELECT 1 FROM v_folds g WHERE g.split = f.split GROUP BY structure_id, motif_id HAVING count(*) > 1)) AS multi_pdb_pwm_groups FROM v_folds f GROUP BY split"""),
    "duplicate_details": with_ctes(FOLD, "SELECT split, structure_id, motif_id, entry, count(*) OVER (PARTITION BY split, structure_id, motif_id) AS n FROM v_folds QUALIFY n > 1"),
    "leakage_audit": with_ctes([V.SQL_FOLDS, _KEYS], f"""SELECT l.level, left_split, right_split, (SELECT count(*) FROM kk a JOIN kk b USING (level, key)
        WHERE a.split = left_split AND b.split = right_split AND level = l.level) AS shared FROM {_PAIRS_SQL} CROSS JOIN (SELECT unnest(['id', 'id_motif', 'motif']) AS level) l"""),
    "dedup_coverage": with_ctes(FOLD, """SELECT split, count(*) AS raw_entries, count(DISTINCT structure_id || '|' || motif_id) AS pdb_pwm, count(DISTINCT structure_id) AS pdb,
        count(*) FILTER (WHERE length(chain) = 1) AS valid_entries, count(DISTINCT structure_id || '|' || motif_id) FILTER (WHERE length(chain) = 1) AS valid_pdb_pwm,
        count(DISTINCT structure_id) FILTER (WHERE length(chain) = 1) AS valid_pdb FROM v_folds GROUP BY split"""),
    "group_mean_metric": with_ctes(EVAL, _each("SELECT '{m}' AS metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n_groups FROM (SELECT grp, avg({m}) AS v FROM v_eval WHERE isfinite({m}) GROUP BY grp)")),
    "best_contact_pick": with_ctes(EVAL, " UNION ALL ".join(
        f"SELECT * FROM (SELECT sample_id, grp, A_contact_pos, A_base_pos, '{r}' AS rule FROM v_eval QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {o}) = 1)"
        for r, o in (("A_contact_pos", "A_contact_pos DESC, sample_id"), ("A_base_pos", "A_base_pos DESC, sample_id"), ("first", "sample_id")))),
    "group_weights": with_ctes(FOLD, "SELECT split, ord, round(1.0::DOUBLE / count(*) OVER (PARTITION BY split, structure_id, motif_id), 6) AS weight FROM v_folds"),
    "same_subset_compare": with_ctes([V.SQL_EVAL, _BYG, f"cm AS (SELECT sample_id FROM bg WHERE method IN ('{_M3}') GROUP BY sample_id HAVING count(DISTINCT method) = 3)",
        f"sb AS (SELECT * FROM bg WHERE method IN ('{_M3}') AND sample_id IN (SELECT sample_id FROM cm))"],
        _each("SELECT method, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, count({m}) AS n FROM sb WHERE {m} IS NOT NULL GROUP BY method")),
    "better_count": with_ctes([V.SQL_EVAL, _BYG], """SELECT count_if(b.pwm_mae < a.pwm_mae) AS better, count_if(b.pwm_mae = a.pwm_mae) AS equal, count(*) AS n
        FROM bg a JOIN bg b USING (sample_id) WHERE a.method = '1-URGENT' AND b.method = '5-LOW'"""),
    "median_metric": with_ctes(EVAL, "SELECT method, round(median(pwm_kl), 8) AS median, count(pwm_kl) AS n FROM v_eval WHERE pwm_kl IS NOT NULL GROUP BY method"),
    "fold_metric_variance": with_ctes(EVAL, "SELECT metric, fold, n, round(fm, 6) AS fold_mean, round(var_pop(fm) OVER (PARTITION BY metric), 6) AS variance, round(em, 6) AS ensemble_mean FROM ("
        + _each("SELECT '{m}' AS metric, sample_id % 5 AS fold, count(*) AS n, avg({m}) AS fm, (SELECT avg({m}) FROM v_eval WHERE isfinite({m})) AS em FROM v_eval WHERE isfinite({m}) GROUP BY ALL") + ")"),
    "leave_component_split": "WITH RECURSIVE " + with_ctes([*FOLD, """e AS (SELECT DISTINCT structure_id AS s, motif_id AS m FROM v_folds),
r AS (SELECT DISTINCT m AS root, m FROM e UNION SELECT r.root, y.m FROM r JOIN e x ON r.m = x.m JOIN e y ON y.s = x.s),
c AS (SELECT m, 'motif_id:' || min(root) AS component FROM r GROUP BY m),
z AS (SELECT component, count(*) AS n FROM v_folds JOIN c ON m = motif_id GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (ORDER BY n DESC, component) AS upto, sum(n) OVER () AS total FROM z)"""],
        "SELECT ord, component, n, least(floor((upto * 2 - n)::DOUBLE * 5 / (total * 2)), 4)::BIGINT AS bucket FROM v_folds JOIN c ON m = motif_id JOIN u USING (component)").removeprefix("WITH "),
    "leave_group_split": with_ctes(FOLD, """SELECT ord, level, ('0x' || substr(md5(key), 1, 8))::BIGINT % 5 AS bucket FROM (SELECT ord, unnest(['id', 'id_motif', 'motif']) AS level,
        unnest([structure_id, structure_id || '|' || motif_id, motif_id]) AS key FROM v_folds)"""),
}
