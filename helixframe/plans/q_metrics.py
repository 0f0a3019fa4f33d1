"""Queries of the evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.checkpoints import cut_lineage
from helixframe.operators import metrics as M
from helixframe.operators import predictions as P
from helixframe.plans import views as V
from helixframe.plans.common import big, r6, table, with_ctes

EVAL_METRICS = ["pwm_mae", "pwm_kl", "site_ap", "A_contact_pos", "A_base_pos"]


def pwm_mae(spark, sf):
    return M.pwm_mae(V.pwm_pairs(spark, sf)).select("sample_id", r6("mae").alias("mae"))


def pwm_kl(spark, sf):
    return M.pwm_kl(V.pwm_pairs(spark, sf)).select("sample_id", r6("kl").alias("kl"))


def ic_pcc(spark, sf):
    return M.ic_pcc(V.pwm_pairs(spark, sf)).select("sample_id", r6("ic_pcc").alias("ic_pcc"))


def rc_aware_kl(spark, sf):
    return M.rc_aware_kl(V.pwm_pairs(spark, sf)).select("sample_id", r6("rc_aware_kl").alias("rc_aware_kl"))


def compare_methods(spark, sf):
    pairs = V.pwm_pairs(spark, sf)
    target = pairs.select("sample_id", "pos", "a", "c", "g", "t")
    ours = pairs.select("sample_id", "pos", "p_a", "p_c", "p_g", "p_t")
    shifted = ours.withColumn("sample_id", F.col("sample_id") + 1)
    flat = target.select("sample_id", "pos", *[F.lit(0.25).alias(f"p_{b}") for b in "acgt"])
    out = M.compare_methods(target, {"ours": ours, "shifted": shifted, "uniform": flat})
    return out.groupBy("method").agg(
        F.count("*").alias("n"), *[r6(F.avg(c)).alias(c) for c in ("mae", "kl", "ic_pcc", "rc_aware_kl")])


def average_precision(spark, sf):
    return M.average_precision(V.binary_rows(spark, sf), ["grp"]).select("grp", r6("ap").alias("ap"))


def top_l_precision(spark, sf):
    return M.top_l_precision(V.binary_rows(spark, sf), ["grp"]).select("grp", r6("top_l_precision").alias("top_l_precision"))


def binary_metrics(spark, sf):
    return M.binary_metrics(V.binary_rows(spark, sf), ["grp"]).select(
        "grp", "tp", "fp", "fn", "tn", r6("f1").alias("f1"), r6("mcc").alias("mcc"), r6("ap").alias("ap"))


_SWEEP = ["f1_at_0.5", "mcc_at_0.5", "best_f1_diagnostic", "best_f1_threshold_diagnostic", "best_mcc_diagnostic",
          "best_mcc_threshold_diagnostic"]


def _plain(name):
    return name.replace("0.5", "half")


def best_threshold(spark, sf):
    return M.best_threshold(V.binary_rows(spark, sf), ["grp"]).select(
        "grp", *[r6(F.col(f"`{c}`")).alias(_plain(c)) for c in _SWEEP])


def global_site_summary(spark, sf):
    out = M.global_site_summary(V.binary_rows(spark, sf))
    return out.select("metric", r6("mean").alias("mean"), "std", "n")


# ------------------------------------------------------------------ evaluation
def eval_inputs(spark, sf):
    """Targets and ensemble predictions on the order-block samples.

    The joined cells stand for the stored samples and predictions: written once,
    then every metric reads them.
    """
    labels = V.contact_cells(spark, sf).withColumn(
        "pwm_mask", F.when((F.col("sample_id") + F.col("slot")) % 5 == 0, 0).otherwise(1))
    pred = P.contact_scores(V.predictions(spark, sf))
    cells = cut_lineage(labels.drop("score").join(pred, ["sample_id", "res_idx", "slot"]))
    site_label = cells.groupBy("sample_id", "res_idx").agg(F.max("contact_label").alias("site_label"))
    sites = site_label.join(P.site_scores(cells), ["sample_id", "res_idx"])
    target = V.sample_pwm(spark, sf).withColumnRenamed("slot", "pos")
    pwm = P.gated_energy_pwm(cells).withColumnRenamed("slot", "pos")
    return cells, sites, target.join(pwm, ["sample_id", "pos"])


def masked_map_metrics(spark, sf):
    cells, _, _ = eval_inputs(spark, sf)
    base = M.masked_map_metrics(cells, "base_label", "a_base", "base_mask").withColumn("map", F.lit("A_base"))
    contact = M.masked_map_metrics(cells, "contact_label", "a_contact", "pwm_mask").withColumn("map", F.lit("A_contact"))
    return base.unionByName(contact).select("sample_id", "map", r6("ap").alias("ap"), r6("top_l_precision").alias("top_l_precision"), r6("top_l").alias("top_l"))


def evaluate_pair(spark, sf):
    rows = M.evaluate_pair(*eval_inputs(spark, sf))
    return rows.select("sample_id", *[r6(c).alias(c) for c in rows.columns if c != "sample_id"])


def evaluate_manifest(spark, sf):
    _, summary = M.evaluate_manifest(*eval_inputs(spark, sf))
    return summary.select("metric", r6("mean").alias("mean"), r6("std").alias("std"), "n")


def summarize_metrics(spark, sf):
    return M.summarize_metrics(V.eval_rows(spark, sf), EVAL_METRICS, ["method"]).select(
        "method", "metric", r6("mean").alias("mean"), r6("std").alias("std"), "n")


def metric_order(spark, sf):
    s = M.summarize_metrics(V.eval_rows(spark, sf).withColumn("zeta", F.col("pwm_mae")).withColumn("alpha", F.col("pwm_mae")),
                            [*EVAL_METRICS, "zeta", "alpha"])
    ordered = s.select("metric", "n", M.metric_order(F.col("metric")).alias("pos")).orderBy("pos", "metric")
    return ordered.select("metric", "n", big("pos").alias("pos"))


def pair_predictions(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[^A-Za-z0-9]", "_").alias("s"))
    targets = p.select(F.concat(F.lit("/data/"), "page_id", F.lit("_"), "s", F.lit(".npz")).alias("target_path"))
    preds = p.where(F.col("page_id") % 6 != 2).select(
        F.concat(F.lit("/preds/"), "page_id", F.lit("_"), "s",
                 F.when(F.col("page_id") % 10 == 9, ".other.npz").otherwise(".pred.npz")).alias("pred_path"))
    return M.pair_predictions(targets, preds)


QUERIES = {
    "pwm_mae": pwm_mae, "pwm_kl": pwm_kl, "ic_pcc": ic_pcc, "rc_aware_kl": rc_aware_kl, "compare_methods": compare_methods,
    "average_precision": average_precision, "top_l_precision": top_l_precision, "binary_metrics": binary_metrics,
    "best_threshold": best_threshold, "global_site_summary": global_site_summary, "masked_map_metrics": masked_map_metrics,
    "evaluate_pair": evaluate_pair, "evaluate_manifest": evaluate_manifest, "summarize_metrics": summarize_metrics,
    "metric_order": metric_order, "pair_predictions": pair_predictions,
}

PAIR = [V.SQL_PWM, V.SQL_PWMPAIR]
_L1 = "abs(a-p_a) + abs(c-p_c) + abs(g-p_g) + abs(t-p_t)"
_KL = "a*(ln(a)-ln(p_a)) + c*(ln(c)-ln(p_c)) + g*(ln(g)-ln(p_g)) + t*(ln(t)-ln(p_t))"
# Pairs -> per-sample metrics, by the textbook two-pass formulas on single cells.
METRICS = """nt AS (SELECT {k}, pos, greatest(a,1e-8) AS a, greatest(c,1e-8) AS c, greatest(g,1e-8) AS g, greatest(t,1e-8) AS t,
    greatest(p_a,1e-8) AS p_a, greatest(p_c,1e-8) AS p_c, greatest(p_g,1e-8) AS p_g, greatest(p_t,1e-8) AS p_t FROM {src}),
np AS (SELECT {k}, pos, a/(a+c+g+t) AS a, c/(a+c+g+t) AS c, g/(a+c+g+t) AS g, t/(a+c+g+t) AS t, p_a/(p_a+p_c+p_g+p_t) AS p_a,
    p_c/(p_a+p_c+p_g+p_t) AS p_c, p_g/(p_a+p_c+p_g+p_t) AS p_g, p_t/(p_a+p_c+p_g+p_t) AS p_t FROM nt),
ni AS (SELECT *, 2 + a*log2(a) + c*log2(c) + g*log2(g) + t*log2(t) AS ic, max(pos) OVER (PARTITION BY {k}) AS last FROM np),
cell AS (SELECT {k}, ic, unnest([a,c,g,t]) AS x, unnest([p_a,p_c,p_g,p_t]) AS y FROM ni),
mean AS (SELECT {k}, sum(ic*x)/sum(ic) AS mx, sum(ic*y)/sum(ic) AS my, sum(ic) AS w FROM cell GROUP BY ALL),
pc AS (SELECT {k}, sum(ic/w*(x-mx)*(y-my)) AS cov, sum(ic/w*(x-mx)*(x-mx)) AS vx, sum(ic/w*(y-my)*(y-my)) AS vy
    FROM cell JOIN mean USING ({k}) GROUP BY ALL),
rc AS (SELECT {k}, avg(x.a*(ln(x.a)-ln(y.p_t)) + x.c*(ln(x.c)-ln(y.p_g)) + x.g*(ln(x.g)-ln(y.p_c)) + x.t*(ln(x.t)-ln(y.p_a))) AS rkl
    FROM ni x JOIN (SELECT {k}, last - pos AS pos, p_a, p_c, p_g, p_t FROM ni) y USING ({k}, pos) GROUP BY ALL),
pm AS (SELECT {k}, mae, kl, CASE WHEN vx*vy > 1e-30 THEN cov/sqrt(vx*vy) ELSE 0 END AS ic_pcc, least(kl, rkl) AS rc_aware_kl
    FROM (SELECT {k}, avg(""" + _L1 + ") AS mae, avg(" + _KL + """) AS kl FROM ni GROUP BY ALL) JOIN pc USING ({k}) JOIN rc USING ({k}))"""


def metric_ctes(src: str, k: str = "sample_id") -> str:
    return METRICS.replace("{k}", k).replace("{src}", src)


def rank_ctes(src: str, k: str, prefix: str = "") -> str:
    part = f"PARTITION BY {k}" if k else ""
    kk = f"{k}, " if k else ""
    grp = f"GROUP BY {k}" if k else ""
    return f"""{prefix}rk AS (SELECT *, row_number() OVER w AS r, sum(y_true) OVER (w ROWS UNBOUNDED PRECEDING) AS tpc, sum(y_true) OVER ({part}) AS npos,
    count(*) OVER ({part}) AS ntot FROM {src} WINDOW w AS ({part} ORDER BY score DESC, row_id)),
{prefix}ap AS (SELECT {kk} coalesce(sum(y_true * tpc / r) / nullif(sum(y_true), 0), 0)::DOUBLE AS ap,
    coalesce(avg(y_true) FILTER (WHERE r <= greatest(1, least(npos, ntot))), 0)::DOUBLE AS top_l_precision, max(npos)::DOUBLE AS top_l FROM {prefix}rk {grp})"""


def f1_sql(tp="tp", fp="fp", fn="fn", tn="tn"):
    p, r = f"({tp}::DOUBLE / greatest({tp}+{fp}, 1))", f"({tp}::DOUBLE / greatest({tp}+{fn}, 1))"
    f1 = f"(2 * {p} * {r} / greatest({p} + {r}, 1e-8))"
    den = f"sqrt(({tp}+{fp})::DOUBLE * ({tp}+{fn}) * ({tn}+{fp}) * ({tn}+{fn}))"
    return f1, f"coalesce(({tp}::DOUBLE*{tn} - {fp}::DOUBLE*{fn}) / nullif({den}, 0), 0)"


def sweep_ctes(src: str, k: str) -> str:
    """Threshold sweep by brute force: every threshold against every row."""
    kk = f"{k}, " if k else ""
    using = f"JOIN {src} b USING ({k})" if k else f"CROSS JOIN {src} b"
    f1, mcc = f1_sql()
    part = f"PARTITION BY {k}" if k else ""
    return f"""th AS (SELECT DISTINCT {kk} score AS th FROM {src} UNION SELECT DISTINCT {kk} 0.5::DOUBLE FROM {src}),
cf AS (SELECT {kk} th, count(*) FILTER (WHERE y_true = 1 AND score >= th) AS tp, count(*) FILTER (WHERE y_true = 0 AND score >= th) AS fp,
    count(*) FILTER (WHERE y_true = 1 AND score < th) AS fn, count(*) FILTER (WHERE y_true = 0 AND score < th) AS tn FROM th {using} GROUP BY ALL),
fm AS (SELECT *, {f1} AS f1, {mcc} AS mcc FROM cf),
fx AS (SELECT *, max(f1) OVER ({part}) AS bf, max(mcc) OVER ({part}) AS bm FROM fm),
sw AS (SELECT {kk} max(f1) FILTER (WHERE th = 0.5) AS f1_at_half, max(mcc) FILTER (WHERE th = 0.5) AS mcc_at_half, max(bf) AS best_f1_diagnostic,
    arg_min(th, (abs(th - 0.5), th)) FILTER (WHERE f1 >= bf - (1e-8 + 1e-5*abs(bf))) AS best_f1_threshold_diagnostic, max(bm) AS best_mcc_diagnostic,
    arg_min(th, (abs(th - 0.5), th)) FILTER (WHERE mcc >= bm - (1e-8 + 1e-5*abs(bm))) AS best_mcc_threshold_diagnostic FROM fx {'GROUP BY ' + k if k else ''})"""


_SWNAMES = [_plain(c) for c in _SWEEP]
GLOBAL_UNPIVOT = " UNION ALL ".join(
    [f"SELECT '{M.GLOBAL_NAMES['ap']}' AS metric, round(ap, 6) AS mean, 0.0::DOUBLE AS std, (SELECT count(*) FROM {{src}}) AS n FROM {{p}}ap"]
    + [f"SELECT '{M.GLOBAL_NAMES[c]}', round({_plain(c)}, 6), 0.0::DOUBLE, (SELECT count(*) FROM {{src}}) FROM sw" for c in _SWEEP])
EVAL_IN = [V.SQL_PWM, V.SQL_CONTACT, V.SQL_MODEL, V.SQL_PRED, V.SQL_SAMPLE_PWM, """cells AS (
  SELECT c.*, CASE WHEN (c.sample_id + c.slot) % 5 = 0 THEN 0 ELSE 1 END AS pwm_mask, a_base, base_logit, backbone_logit,
    1/(1+exp(-backbone_logit)) AS a_backbone, greatest(a_base, 1/(1+exp(-backbone_logit))) AS a_contact, e_a, e_c, e_g, e_t
  FROM v_contact c JOIN v_pred USING (sample_id, res_idx, slot)),
sites AS (SELECT sample_id, res_idx, max(contact_label) AS site_label, 1/(1+exp(-max(greatest(base_logit, backbone_logit)))) AS site_prob FROM cells GROUP BY ALL),
lg AS (SELECT sample_id, slot, sum(a_base*e_a) AS la, sum(a_base*e_c) AS lc, sum(a_base*e_g) AS lg, sum(a_base*e_t) AS lt FROM cells GROUP BY ALL),
spair AS (SELECT sample_id, slot AS pos, s.a, s.c, s.g, s.t, exp(la)/z AS p_a, exp(lc)/z AS p_c, exp(lg)/z AS p_g, exp(lt)/z AS p_t
  FROM (SELECT *, exp(la)+exp(lc)+exp(lg)+exp(lt) AS z FROM lg) JOIN v_spwm s USING (sample_id, slot))"""]
_MAPROWS = """mrows AS (SELECT sample_id || ':A_base' AS key, res_idx*100 + slot AS row_id, base_label AS y_true, a_base AS score FROM cells WHERE base_mask = 1
  UNION ALL SELECT sample_id || ':A_backbone', res_idx*100 + slot, backbone_label, a_backbone FROM cells WHERE pwm_mask = 1
  UNION ALL SELECT sample_id || ':A_contact', res_idx*100 + slot, contact_label, a_contact FROM cells WHERE pwm_mask = 1
  UNION ALL SELECT sample_id || ':site', res_idx*100, site_label, site_prob FROM sites)"""
_F1, _MCC = f1_sql()
_MAPCOLS = ["ap", "top_l_precision", "top_l"]
_EVAL = f"""sc AS (SELECT sample_id, count(*) FILTER (WHERE site_label = 1 AND site_prob >= 0.5) AS tp, count(*) FILTER (WHERE site_label = 0 AND site_prob >= 0.5) AS fp,
    count(*) FILTER (WHERE site_label = 1 AND site_prob < 0.5) AS fn, count(*) FILTER (WHERE site_label = 0 AND site_prob < 0.5) AS tn,
    count(*)::DOUBLE AS n_residue, sum(site_label)::DOUBLE AS site_pos FROM sites GROUP BY sample_id),
tot AS (SELECT sample_id, sum(base_label)::DOUBLE AS A_base_pos, sum(backbone_label)::DOUBLE AS A_backbone_pos, sum(contact_label)::DOUBLE AS A_contact_pos FROM cells GROUP BY sample_id),
ev AS (SELECT sample_id, n_residue, site_pos, A_base_pos, A_backbone_pos, A_contact_pos, mae AS pwm_mae, kl AS pwm_kl, ic_pcc AS pwm_ic_pcc, rc_aware_kl AS pwm_rc_aware_kl,
  {", ".join(f"coalesce({m}.{c}, 0) AS {m}_{c}" for m in ("A_base", "A_backbone", "A_contact") for c in _MAPCOLS)},
  site.ap AS site_ap, {_F1} AS site_f1, {_MCC} AS site_mcc FROM sc JOIN tot USING (sample_id) JOIN pm USING (sample_id)
  {" ".join(f"LEFT JOIN ap {m} ON {m}.key = sample_id || ':{m}'" for m in ("A_base", "A_backbone", "A_contact", "site"))})"""
EVALS = [*EVAL_IN, metric_ctes("spair"), _MAPROWS, rank_ctes("mrows", "key"), _EVAL]
EV_COLS = ["n_residue", "site_pos", "A_base_pos", "A_backbone_pos", "A_contact_pos", "pwm_mae", "pwm_kl", "pwm_ic_pcc", "pwm_rc_aware_kl",
           *[f"{m}_{c}" for m in ("A_base", "A_backbone", "A_contact") for c in _MAPCOLS], "site_ap", "site_f1", "site_mcc"]


def summary_sql(src: str, cols: list[str], by: str = "") -> str:
    head = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{c}' AS metric, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count({c}) AS n FROM {src} "
        f"WHERE {c} IS NOT NULL AND isfinite({c}::DOUBLE) {'GROUP BY ' + by if by else ''}" for c in cols)


_MANIFEST_EVAL = with_ctes([*EVALS, "srows AS (SELECT sample_id*100 + res_idx AS row_id, site_label AS y_true, site_prob AS score FROM sites)",
                            rank_ctes("srows", "", "g"), sweep_ctes("srows", "")],
                           summary_sql("ev", EV_COLS) + " UNION ALL " + GLOBAL_UNPIVOT.replace("{src}", "srows").replace("{p}", "g"))

ORACLES = {
    "pwm_mae": with_ctes(PAIR, f"SELECT sample_id, round(avg({_L1}), 6) AS mae FROM v_pair GROUP BY sample_id"),
    "pwm_kl": with_ctes(PAIR, f"SELECT sample_id, round(avg({_KL}), 6) AS kl FROM v_pair GROUP BY sample_id"),
    "ic_pcc": with_ctes([*PAIR, metric_ctes("v_pair")], "SELECT sample_id, round(ic_pcc, 6) AS ic_pcc FROM pm"),
    "rc_aware_kl": with_ctes([*PAIR, metric_ctes("v_pair")], "SELECT sample_id, round(rc_aware_kl, 6) AS rc_aware_kl FROM pm"),
    "compare_methods": with_ctes([*PAIR, """mp AS (SELECT 'ours|' || sample_id AS sample_id, pos, a, c, g, t, p_a, p_c, p_g, p_t FROM v_pair
        UNION ALL SELECT 'shifted|' || x.sample_id, x.pos, x.a, x.c, x.g, x.t, y.p_a, y.p_c, y.p_g, y.p_t FROM v_pair x JOIN v_pair y ON y.sample_id + 1 = x.sample_id AND y.pos = x.pos
        UNION ALL SELECT 'uniform|' || sample_id, pos, a, c, g, t, .25, .25, .25, .25 FROM v_pair)""", metric_ctes("mp")],
        "SELECT split_part(sample_id, '|', 1) AS method, count(*) AS n, round(avg(mae), 6) AS mae, round(avg(kl), 6) AS kl, round(avg(ic_pcc), 6) AS ic_pcc, round(avg(rc_aware_kl), 6) AS rc_aware_kl FROM pm GROUP BY ALL"),
    "average_precision": with_ctes([V.SQL_BINARY, rank_ctes("v_bin", "grp")], "SELECT grp, round(ap, 6) AS ap FROM ap"),
    "top_l_precision": with_ctes([V.SQL_BINARY, rank_ctes("v_bin", "grp")], "SELECT grp, round(top_l_precision, 6) AS top_l_precision FROM ap"),
    "binary_metrics": with_ctes([V.SQL_BINARY, rank_ctes("v_bin", "grp"), """cm AS (SELECT grp, count(*) FILTER (WHERE y_true = 1 AND score >= 0.5) AS tp,
        count(*) FILTER (WHERE y_true = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y_true = 1 AND score < 0.5) AS fn,
        count(*) FILTER (WHERE y_true = 0 AND score < 0.5) AS tn FROM v_bin GROUP BY grp)"""],
        f"SELECT grp, tp, fp, fn, tn, round({_F1}, 6) AS f1, round({_MCC}, 6) AS mcc, round(ap, 6) AS ap FROM cm JOIN ap USING (grp)"),
    "best_threshold": with_ctes([V.SQL_BINARY, sweep_ctes("v_bin", "grp")], "SELECT grp, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SWNAMES) + " FROM sw"),
    "global_site_summary": with_ctes([V.SQL_BINARY, rank_ctes("v_bin", "", "g"), sweep_ctes("v_bin", "")], GLOBAL_UNPIVOT.replace("{src}", "v_bin").replace("{p}", "g")),
    "masked_map_metrics": with_ctes([*EVAL_IN, _MAPROWS, rank_ctes("mrows", "key")], """SELECT split_part(key, ':', 1)::BIGINT AS sample_id, split_part(key, ':', 2) AS map,
        round(ap, 6) AS ap, round(CASE WHEN top_l > 0 THEN top_l_precision ELSE 0 END, 6) AS top_l_precision, top_l FROM ap WHERE split_part(key, ':', 2) IN ('A_base', 'A_contact')"""),
    "evaluate_pair": with_ctes(EVALS, "SELECT sample_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in EV_COLS) + " FROM ev"),
    "evaluate_manifest": _MANIFEST_EVAL,
    "summarize_metrics": with_ctes([V.SQL_EVAL], summary_sql("v_eval", EVAL_METRICS, "method")),
    "metric_order": with_ctes([V.SQL_EVAL], """SELECT 'pwm_mae' AS metric, count(*) AS n, 0::BIGINT AS pos FROM v_eval
        UNION ALL SELECT 'pwm_kl', count(pwm_kl), 1 FROM v_eval UNION ALL SELECT 'site_ap', count(*) FILTER (WHERE isfinite(site_ap)), 10 FROM v_eval
        UNION ALL SELECT 'A_base_pos', count(*), 22 FROM v_eval UNION ALL SELECT 'A_contact_pos', count(*), 24 FROM v_eval
        UNION ALL SELECT 'alpha', count(*), 25 FROM v_eval UNION ALL SELECT 'zeta', count(*), 25 FROM v_eval"""),
    "pair_predictions": """WITH p AS (SELECT page_id, page_id || '_' || regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') AS stem FROM pages)
        SELECT stem, '/data/' || stem || '.npz' AS target_path, CASE WHEN ok THEN '/preds/' || stem || '.pred.npz' END AS pred_path,
          CASE WHEN NOT ok THEN 'Missing prediction ' || stem || '.pred.npz' END AS error
        FROM (SELECT *, page_id % 6 <> 2 AND page_id % 10 <> 9 AS ok FROM p)""",
}
