"""Queries over scores and counts: metrics, views, thresholds, alert burden."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import statdist as D
from ..operators import burden as B
from ..operators import counts as C
from . import bindings as X
from .registry import (GRID, LI, SCORES, ba_sql, counts_sql, pooled_sql, ppv_sql, query, r6, u)

K = ["model", "split_seed", "domain"]
KS = 'model, split_seed, "domain"'
KD = 'model, "domain"'
COUNTS = SCORES + ", " + counts_sql(KS)
POOLED = COUNTS + ", " + pooled_sql(KD)
RATIO = 0.25


def _counts(spark, d, keys=K):
    return C.counts_at(X.scores(spark, d), C.TAU_GRID, keys)


def _pooled(spark, d):
    return C.pool_counts(_counts(spark, d), ["model", "domain", "tau"])


@query("counts_by_threshold", f"WITH {COUNTS} SELECT {KS}, tau, tp, fp, fn, tn FROM counts")
def counts_by_threshold(spark, d):
    """A12, P25."""
    return _counts(spark, d)


@query("counts_by_cluster", f"""WITH {SCORES}, {counts_sql('model, split_seed, "domain", grp')}
SELECT model, split_seed, "domain", grp, tau, tp, fp, fn, tn FROM counts""")
def counts_by_cluster(spark, d):
    """A13, J14."""
    c = C.counts_at(X.scores(spark, d), C.TAU_GRID, K + ["grp"])
    return C.densify(c, C.TAU_GRID, K, "grp")


@query("pooled_operating_points", f"""WITH {POOLED}
SELECT {KD}, tau, tp, fp, fn, tn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(corpus_precision, 6) AS corpus_precision,
  round(fpr_lo, 6) AS fpr_lo, round(fpr_hi, 6) AS fpr_hi, round(tpr_lo, 6) AS tpr_lo, round(tpr_hi, 6) AS tpr_hi FROM pooled""")
def pooled_operating_points(spark, d):
    """A22, I6."""
    return r6(_pooled(spark, d))


@query("prevalence_sweep", f"""WITH {POOLED},
g AS (SELECT *, {ppv_sql('tpr', 'fpr', 'pi')} AS v FROM pooled, (SELECT unnest([1e-4, 5e-4, 1e-3, 2e-3, 5e-3, 1e-2, 5e-2, 0.1e0, 0.2e0, 0.5e0]) AS pi)
      WHERE abs(tau - 0.5e0) < 1e-9)
SELECT "domain", pi, round(min(v), 6) AS ppv_min, round(max(v), 6) AS ppv_max, round(max(v) / nullif(min(v), 0), 6) AS spread,
  round(avg(corpus_precision / nullif(v, 0)), 6) AS collapse_mean FROM g GROUP BY "domain", pi""")
def prevalence_sweep(spark, d):
    """O4, J13."""
    return r6(B.prevalence_sweep(_pooled(spark, d).filter(S.same_tau("tau", 0.5)), ["domain"]))


@query("ppv_bounds", f"""WITH {POOLED}
SELECT {KD}, round({ppv_sql('tpr', 'fpr')}, 6) AS ppv, round({ppv_sql('tpr', 'fpr_lo')}, 6) AS ppv_best_case,
  round({ppv_sql('tpr', 'fpr_hi')}, 6) AS ppv_worst_case, round(corpus_precision / nullif({ppv_sql('tpr', 'fpr')}, 0), 6) AS collapse
FROM pooled WHERE abs(tau - 0.5e0) < 1e-9""")
def ppv_bounds(spark, d):
    """O3, O4."""
    p = B.ppv_bounds(_pooled(spark, d).filter(S.same_tau("tau", 0.5)))
    return r6(p.select("model", "domain", "ppv", "ppv_best_case", "ppv_worst_case", "collapse"))


def _target_cols(t: float) -> str:
    n = f"{int(round(t * 100)):02d}"
    return (f"round(min(CASE WHEN v >= {t}e0 THEN tau END), 6) AS tau_for_ppv_{n}, "
            f"round(arg_min(tpr, tau) FILTER (WHERE v >= {t}e0), 6) AS tpr_for_ppv_{n}")


REACH = f"""WITH {POOLED}, a AS (SELECT *, {ppv_sql('tpr', 'fpr')} AS v, {ppv_sql('tpr', 'fpr_hi')} AS w FROM pooled),
ok AS (SELECT *, row_number() OVER (PARTITION BY {KD} ORDER BY v DESC NULLS LAST, tau) AS rn FROM a WHERE tpr >= 0.1e0),
best AS (SELECT {KD}, v, tau, tpr, fpr, fp, fp + tn AS n_benign, w FROM ok WHERE rn = 1 AND v IS NOT NULL),
hit AS (SELECT {KD}, {', '.join(_target_cols(t) for t in (0.01, 0.05, 0.1))} FROM ok GROUP BY {KD}),
allk AS (SELECT DISTINCT {KD} FROM a)
SELECT allk.model, allk."domain", round(v, 6) AS ppv_max, best.tau AS tau_at_max, round(best.tpr, 6) AS tpr_at_max, round(best.fpr, 6) AS fpr_at_max,
  best.fp AS fp_at_max, best.n_benign, round(w, 6) AS ppv_worst_at_max, tau_for_ppv_01, tpr_for_ppv_01, tau_for_ppv_05, tpr_for_ppv_05, tau_for_ppv_10, tpr_for_ppv_10
FROM allk LEFT JOIN best USING (model, "domain") LEFT JOIN hit USING (model, "domain")"""


@query("ppv_reachability", REACH)
def ppv_reachability(spark, d):
    """The flagship. Scores to counts, pooled rates, best reachable precision."""
    return r6(B.ppv_reachability(_pooled(spark, d), ["model", "domain"]))


@query("ppv_crossings", f"""WITH {COUNTS},
s AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS recall, fp / nullif(fp + tn, 0)::DOUBLE AS fpr FROM counts),
o AS (SELECT {KD}, tau, avg({ppv_sql('recall', 'fpr')}) AS ppv, avg(recall) AS recall,
       avg(recall * (240000e0 * (0.002e0 / (1e0 - 0.002e0))) + fpr * 240000e0) AS alerts FROM s GROUP BY {KD}, tau)
SELECT {KD}, ppv_bar, (min(tau) FILTER (WHERE ppv >= ppv_bar) IS NOT NULL)::INT AS reachable, min(tau) FILTER (WHERE ppv >= ppv_bar) AS tau,
  round(arg_min(recall, tau) FILTER (WHERE ppv >= ppv_bar), 6) AS recall_there, round(arg_min(alerts, tau) FILTER (WHERE ppv >= ppv_bar), 6) AS alerts_there
FROM o, (SELECT unnest([0.1e0, 0.25e0, 0.5e0]) AS ppv_bar) GROUP BY {KD}, ppv_bar""")
def ppv_crossings(spark, d):
    """O5, O6."""
    c = _counts(spark, d).withColumn("tpr", S.recall()).withColumn("fpr", S.fpr())
    o = B.operational(B.cross_grid(c, pi=[S.PI], lambda_b=[S.LAMBDA_B])).withColumn("recall", F.col("tpr"))
    return r6(B.ppv_crossings(o, ["model", "domain"]))


@query("source_thresholds", f"""WITH {COUNTS}
SELECT model, split_seed, coalesce(max(CASE WHEN tp / nullif(tp + fn, 0)::DOUBLE >= 0.5e0 THEN tau END), min(tau)) AS tau_star
FROM counts WHERE "domain" = 'source_heldout' GROUP BY model, split_seed""")
def source_thresholds(spark, d):
    """O10."""
    return B.source_thresholds(_counts(spark, d).filter("domain = 'source_heldout'"), ["model", "split_seed"])


T3 = repr(D.t_ppf(0.975, len(X.SEEDS) - 1)) + "e0"
NB = f"sqrt(1e0 / n + {RATIO}e0)"


def _nb(m: str, clip: bool = True) -> str:
    lo = f"CASE WHEN n >= 2 AND {m}_sd > 0 THEN {m}_m - {T3} * {m}_sd * {NB} ELSE {m}_m END"
    hi = f"CASE WHEN n >= 2 AND {m}_sd > 0 THEN {m}_m + {T3} * {m}_sd * {NB} ELSE {m}_m END"
    if clip:
        lo, hi = f"greatest(0e0, {lo})", f"least(1e0, {hi})"
    return f"{m}_m AS {m}, {lo} AS {m}_lo, {hi} AS {m}_hi"


def _tri(lo: str, hi: str, b: str, below: bool) -> str:
    if below:
        return f"CASE WHEN {hi} <= {b} THEN 'pass' WHEN {lo} > {b} THEN 'fail' ELSE 'inconclusive' END"
    return f"CASE WHEN {lo} >= {b} THEN 'pass' WHEN {hi} < {b} THEN 'fail' ELSE 'inconclusive' END"


ALERT = f"""{COUNTS}, star AS (
  SELECT model, split_seed, coalesce(max(CASE WHEN tp / nullif(tp + fn, 0)::DOUBLE >= 0.5e0 THEN tau END), min(tau)) AS tau_star
  FROM counts WHERE "domain" = 'source_heldout' GROUP BY model, split_seed),
at0 AS (SELECT c.*, tau_star, row_number() OVER (PARTITION BY model, split_seed ORDER BY abs(tau - tau_star), tau) AS rn
  FROM counts c JOIN star USING (model, split_seed) WHERE "domain" = 'target'),
at1 AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS recall, fp / nullif(fp + tn, 0)::DOUBLE AS fpr FROM at0 WHERE rn = 1),
m AS (SELECT model, count(*) AS n, avg(recall) AS recall_m, stddev_samp(recall) AS recall_sd, avg(fpr) AS fpr_m, stddev_samp(fpr) AS fpr_sd,
  min(tau_star) AS tau_star_min, max(tau_star) AS tau_star_max,
  count(*) FILTER (WHERE recall >= 0.5e0 AND fpr * 240000e0 <= 200e0 AND {ppv_sql('recall', 'fpr')} >= 0.1e0) AS splits_meeting_all
  FROM at1 GROUP BY model),
iv AS (SELECT model, tau_star_min, tau_star_max, splits_meeting_all, {_nb('recall')}, {_nb('fpr')} FROM m),
al AS (SELECT *, {ppv_sql('recall', 'fpr')} AS ppv, {ppv_sql('recall_lo', 'fpr_hi')} AS ppv_lo,
  CASE WHEN fpr_lo = 0 AND recall_hi > 0 THEN 1e0 ELSE {ppv_sql('recall_hi', 'fpr_lo')} END AS ppv_hi FROM iv),
oc AS (SELECT *, {_tri('recall_lo', 'recall_hi', '0.5e0', False)} AS recall_outcome,
  {_tri('fpr_lo * 240000e0', 'fpr_hi * 240000e0', '200e0', True)} AS alerts_outcome, {_tri('ppv_lo', 'ppv_hi', '0.1e0', False)} AS ppv_outcome FROM al),
term AS (SELECT *, CASE WHEN 'fail' IN (recall_outcome, alerts_outcome, ppv_outcome) THEN 'fail'
  WHEN recall_outcome = 'pass' AND alerts_outcome = 'pass' AND ppv_outcome = 'pass' THEN 'pass' ELSE 'inconclusive' END AS alert_term FROM oc)"""


def _alert(spark, d):
    c = _counts(spark, d).persist()
    star = B.source_thresholds(c.filter("domain = 'source_heldout'"), ["model", "split_seed"])
    at = B.at_threshold(c.filter("domain = 'target'"), star, ["model", "split_seed"], ["model", "split_seed"])
    return B.alert_term(at, ["model"], RATIO)


@query("alert_term", f"""WITH {ALERT} SELECT model, tau_star_min, tau_star_max, splits_meeting_all, round(recall, 6) AS recall, round(recall_lo, 6) AS recall_lo,
  round(recall_hi, 6) AS recall_hi, round(fpr, 6) AS fpr, round(fpr_lo, 6) AS fpr_lo, round(fpr_hi, 6) AS fpr_hi, round(ppv, 6) AS ppv,
  round(ppv_lo, 6) AS ppv_lo, round(ppv_hi, 6) AS ppv_hi, recall_outcome, alerts_outcome, ppv_outcome, alert_term FROM term""")
def alert_term(spark, d):
    """O10, O11, O14, T8, I2."""
    a = _alert(spark, d)
    return r6(a.select("model", "tau_star_min", "tau_star_max", "splits_meeting_all", "recall", "recall_lo", "recall_hi", "fpr", "fpr_lo",
                       "fpr_hi", "ppv", "ppv_lo", "ppv_hi", "recall_outcome", "alerts_outcome", "ppv_outcome", "alert_term"))


BA_SPLIT = f"""bas AS (SELECT model, split_seed, max(CASE WHEN "domain" = 'source_heldout' THEN {ba_sql()} END)
  - max(CASE WHEN "domain" = 'target' THEN {ba_sql()} END) AS d FROM counts WHERE abs(tau - 0.5e0) < 1e-9 GROUP BY model, split_seed),
gm AS (SELECT model, count(d) AS n, avg(d) AS d_m, stddev_samp(d) AS d_sd FROM bas GROUP BY model),
gen AS (SELECT model, {_nb('d', False)} FROM gm)"""


def _ba_diff(c):
    b = c.filter(S.same_tau("tau", 0.5)).withColumn("ba", S.balanced_accuracy())
    return b.groupBy("model", "split_seed").agg((F.max(F.when(F.col("domain") == "source_heldout", F.col("ba")))
                                                 - F.max(F.when(F.col("domain") == "target", F.col("ba")))).alias("d"))


@query("deployability_test", f"""WITH {ALERT}, {BA_SPLIT}
SELECT model, round(d, 6) AS d_ba, {_tri('d_lo', 'd_hi', '0.1e0', True)} AS generalization, alert_term,
  CASE WHEN alert_term = 'fail' OR {_tri('d_lo', 'd_hi', '0.1e0', True)} = 'fail' THEN 'fail'
       WHEN alert_term = 'pass' AND {_tri('d_lo', 'd_hi', '0.1e0', True)} = 'pass' THEN 'pass' ELSE 'inconclusive' END AS verdict
FROM gen JOIN term USING (model)""")
def deployability_test(spark, d):
    """O15."""
    from ..operators import inference as I
    gen = I.paired_interval(_ba_diff(_counts(spark, d)), ["model"], "d", RATIO, p_values=False)
    r = B.deployability_test(gen.select("model", F.col("mean").alias("d_ba"), "nb_lo", "nb_hi"), _alert(spark, d).select("model", "alert_term"), ["model"])
    return r6(r.select("model", "d_ba", "generalization", "alert_term", "verdict"))


@query("pooled_nb_point", f"""WITH {COUNTS},
s AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS recall, fp / nullif(fp + tn, 0)::DOUBLE AS fpr FROM counts WHERE abs(tau - 0.5e0) < 1e-9),
m AS (SELECT {KD}, count(*) AS n, avg(recall) AS recall_m, stddev_samp(recall) AS recall_sd, avg(fpr) AS fpr_m, stddev_samp(fpr) AS fpr_sd,
  sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE AS pr, sum(fp) / nullif(sum(fp) + sum(tn), 0)::DOUBLE AS pf, sum(tp) / nullif(sum(tp) + sum(fp), 0)::DOUBLE AS cp FROM s GROUP BY {KD}),
iv AS (SELECT {KD}, pr, pf, cp, {_nb('recall')}, {_nb('fpr')} FROM m)
SELECT {KD}, round(recall, 6) AS recall, round(recall_lo, 6) AS recall_lo, round(recall_hi, 6) AS recall_hi, round(fpr, 6) AS fpr,
  round(fpr_lo, 6) AS fpr_lo, round(fpr_hi, 6) AS fpr_hi, round(pr, 6) AS pooled_recall, round(pf, 6) AS pooled_fpr, round(cp, 6) AS corpus_precision FROM iv""")
def pooled_nb_point(spark, d):
    """O12."""
    r = B.pooled_operating_point(_counts(spark, d), ["model", "domain"], "split_seed", RATIO)
    return r6(r.select("model", "domain", "recall", "recall_lo", "recall_hi", "fpr", "fpr_lo", "fpr_hi", "pooled_recall", "pooled_fpr", "corpus_precision"))


@query("oracle_alert", f"""WITH {POOLED}, a AS (SELECT *, {ppv_sql('tpr', 'fpr')} AS v, 240000e0 * fpr AS al FROM pooled)
SELECT {KD}, round(max(v) FILTER (WHERE tpr >= 0.5e0), 6) AS best_ppv,
  min(tau) FILTER (WHERE tpr >= 0.5e0 AND v = (SELECT max(v) FROM a b WHERE b.model = a.model AND b."domain" = a."domain" AND b.tpr >= 0.5e0)) AS tau_best_ppv,
  round(min(al) FILTER (WHERE tpr >= 0.5e0), 6) AS min_alerts,
  min(tau) FILTER (WHERE tpr >= 0.5e0 AND al = (SELECT min(al) FROM a b WHERE b.model = a.model AND b."domain" = a."domain" AND b.tpr >= 0.5e0)) AS tau_min_alerts,
  round(max(v) FILTER (WHERE tpr >= 0.1e0), 6) AS best_ppv_r10 FROM a GROUP BY {KD}""")
def oracle_alert(spark, d):
    """O13, T5."""
    return r6(B.oracle_alert(_pooled(spark, d), ["model", "domain"]).drop("recall_at_min_alerts"))


@query("predicate_verdict", f"""WITH {POOLED}, {BA_SPLIT},
a AS (SELECT model, max({ppv_sql('tpr', 'fpr')}) AS v, min(240000e0 * fpr) AS al, max(({ppv_sql('tpr', 'fpr')} >= 0.1e0 AND 240000e0 * fpr <= 200e0)::INT) AS ap
      FROM pooled WHERE "domain" = 'target' AND tpr >= 0.5e0 GROUP BY model)
SELECT gen.model, round(d_hi, 6) AS upper, round(v, 6) AS best_ppv_at_rmin, round(al, 6) AS min_false_alerts_at_rmin, coalesce(ap, 0)::INT AS alert_pass,
  (d_hi <= 0.1e0)::INT AS gen_pass, ((d_hi <= 0.1e0)::INT * coalesce(ap, 0))::INT AS verdict FROM gen LEFT JOIN a USING (model)""")
def predicate_verdict(spark, d):
    """O15, earlier form."""
    from ..operators import inference as I
    gen = I.paired_interval(_ba_diff(_counts(spark, d)), ["model"], "d", RATIO, p_values=False)
    return r6(B.predicate(gen.select("model", F.col("nb_hi").alias("upper")), _pooled(spark, d).filter("domain = 'target'"), ["model"]))


OPER = """la AS (SELECT *, lambda_b * (pi / greatest(1e0 - pi, 1e-12)) AS la FROM grid),
op AS (SELECT *, tpr * la AS tp_h, fpr * lambda_b AS fp_h, (1e0 - tpr) * la AS fn_h, (1e0 - fpr) * lambda_b AS tn_h FROM la)"""
PIL = f"""{POOLED}, grid AS (SELECT * FROM pooled, (SELECT unnest([1e-4, 5e-4, 1e-3, 2e-3, 5e-3, 1e-2, 5e-2, 0.1e0, 0.2e0, 0.5e0]) AS pi),
  (SELECT unnest([24000e0, 240000e0, 2400000e0, 24000000e0]) AS lambda_b) WHERE abs(tau - 0.5e0) < 1e-9), {OPER}"""


def _grid(spark, d):
    return B.pi_lambda_grid(_pooled(spark, d).filter(S.same_tau("tau", 0.5)))


@query("pi_lambda_grid", f"""WITH {PIL} SELECT {KD}, pi, lambda_b, round(tp_h / nullif(tp_h + fp_h, 0), 6) AS ppv, round(tn_h / nullif(tn_h + fn_h, 0), 6) AS npv,
  round(1e0 - tp_h / nullif(tp_h + fp_h, 0), 6) AS fdr, round(tp_h + fp_h, 4) AS alerts_per_hour, round((tp_h + fp_h) * 24e0, 4) AS alerts_per_day,
  round(fpr * 1e5 + tpr * 1e5 * (pi / greatest(1e0 - pi, 1e-12)), 4) AS alerts_per_100k_benign, round(fn_h, 4) AS missed_attacks_per_hour,
  round({ppv_sql('tpr_lo', 'fpr_hi', 'pi')}, 6) AS ppv_lo, round({ppv_sql('tpr_hi', 'fpr_lo', 'pi')}, 6) AS ppv_hi FROM op""")
def pi_lambda_grid(spark, d):
    """J13, O2."""
    g = _grid(spark, d)
    r4 = lambda c: F.round(c, 4).alias(c)                                  # noqa: E731
    return g.select("model", "domain", "pi", "lambda_b", *[F.round(c, 6).alias(c) for c in ("ppv", "npv", "fdr", "ppv_lo", "ppv_hi")],
                    *[r4(c) for c in ("alerts_per_hour", "alerts_per_day", "alerts_per_100k_benign", "missed_attacks_per_hour")])


@query("pi_required", f"""WITH {PIL} SELECT {KD}, ppv_bar, min(CASE WHEN tp_h / nullif(tp_h + fp_h, 0) >= ppv_bar THEN pi END) AS pi_required,
  (min(CASE WHEN tp_h / nullif(tp_h + fp_h, 0) >= ppv_bar THEN pi END) IS NOT NULL)::INT AS reachable
FROM op, (SELECT unnest([0.25e0, 0.5e0, 0.9e0]) AS ppv_bar) WHERE lambda_b = 240000e0 GROUP BY {KD}, ppv_bar""")
def pi_required(spark, d):
    """O8."""
    return B.pi_required(_grid(spark, d).filter(F.col("lambda_b") == S.LAMBDA_B), ["model", "domain"])


@query("separability", f"""WITH {PIL}, v AS (SELECT {KD}, pi, max(tp_h / nullif(tp_h + fp_h, 0)) - min(tp_h / nullif(tp_h + fp_h, 0)) AS dv,
  max(tp_h + fp_h) FILTER (WHERE lambda_b = 240000e0) AS base FROM op GROUP BY {KD}, pi),
w AS (SELECT max(abs(tp_h + fp_h - base * (lambda_b / 240000e0))) AS dd FROM op JOIN v USING (model, "domain", pi))
SELECT round(max(dv), 6) AS max_ppv_variation, round((SELECT dd FROM w), 6) AS max_linearity_dev FROM v""")
def separability(spark, d):
    """A52."""
    return r6(B.separability(_grid(spark, d), ["model", "domain"]))


@query("ppv_spread", f"""WITH {PIL}, g AS (SELECT *, tp_h / nullif(tp_h + fp_h, 0) AS v FROM op WHERE lambda_b = 240000e0)
SELECT "domain", pi, count(*) AS n_models, round(min(v), 6) AS ppv_min, round(max(v), 6) AS ppv_max, round(max(corpus_precision) - min(corpus_precision), 6) AS corpus_precision_range,
  round(avg(corpus_precision) / avg(v), 6) AS collapse_factor, arg_max(model, (v, model)) AS best_model,
  round(quantile_cont(fp_h, 0.5), 4) AS false_alerts_median, round(max(v) / min(v), 6) AS ppv_ratio
FROM g WHERE v > 0 GROUP BY "domain", pi HAVING count(*) >= 2""")
def ppv_spread(spark, d):
    """A53."""
    r = r6(B.ppv_spread(_grid(spark, d), ["domain"]))
    return r.withColumn("false_alerts_median", F.round("false_alerts_median", 4))


@query("alert_grid", f"""WITH {POOLED}, g AS (SELECT *, {ppv_sql('tpr', 'fpr')} AS v FROM pooled WHERE tpr >= 0.5e0),
per AS (SELECT "domain", a_max, rho, model, max((v >= rho AND 240000e0 * fpr <= a_max)::INT) AS ok
  FROM g, (SELECT unnest([100e0, 1000e0, 10000e0, 100000e0]) AS a_max), (SELECT unnest([0.01e0, 0.05e0, 0.1e0, 0.5e0]) AS rho) GROUP BY "domain", a_max, rho, model)
SELECT "domain", a_max, rho, coalesce(sum(ok), 0)::BIGINT AS n_models FROM per GROUP BY "domain", a_max, rho""")
def alert_grid(spark, d):
    """O17."""
    g = B.alert_grid(_pooled(spark, d), [100.0, 1000.0, 10000.0, 100000.0], [0.01, 0.05, 0.1, 0.5], ["domain"])
    return g.withColumn("n_models", F.coalesce("n_models", F.lit(0)))


@query("fold_spread", f"""WITH {COUNTS}, f AS (SELECT *, fp / greatest(fp + tn, 1)::DOUBLE AS q FROM counts WHERE abs(tau - 0.5e0) < 1e-9)
SELECT {KD}, count(*) AS n_folds, round(min(q), 6) AS fold_fpr_min, round(quantile_cont(q, 0.5), 6) AS fold_fpr_median, round(max(q), 6) AS fold_fpr_max,
  count(*) FILTER (WHERE fp = 0) AS n_folds_with_zero_fp, quantile_cont((fp + tn)::DOUBLE, 0.5) AS benign_per_fold_median,
  round((sum(tp) / (sum(tp) + sum(fn))::DOUBLE) / nullif(sum(fp) / (sum(fp) + sum(tn))::DOUBLE, 0), 6) AS lr_plus FROM f GROUP BY {KD}""")
def fold_spread(spark, d):
    """A23."""
    return r6(C.fold_spread(_counts(spark, d).filter(S.same_tau("tau", 0.5)), ["model", "domain"]))


@query("estimator_contrast", f"""WITH {COUNTS}, f AS (SELECT *, {ppv_sql('(tp / nullif(tp + fn, 0)::DOUBLE)', '(fp / nullif(fp + tn, 0)::DOUBLE)')} AS v FROM counts WHERE abs(tau - 0.5e0) < 1e-9)
SELECT {KD}, count(*) AS folds, count(*) FILTER (WHERE fp = 0) AS folds_fpr_zero, count(*) FILTER (WHERE v >= 0.999e0) AS folds_ppv_one, round(avg(v), 6) AS mean_of_folds,
  round(quantile_cont(v, 0.5), 6) AS median_of_folds, round({ppv_sql('(sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE)', '(sum(fp) / nullif(sum(fp) + sum(tn), 0)::DOUBLE)')}, 6) AS pooled FROM f GROUP BY {KD}""")
def estimator_contrast(spark, d):
    """A24."""
    return r6(C.estimator_contrast(_counts(spark, d).filter(S.same_tau("tau", 0.5)), ["model", "domain"]))


# ------------------------------------------------------------- metrics
CONF = f"""{SCORES}, conf AS (SELECT {KS}, count(*) FILTER (WHERE y = 1 AND score >= 0.5e0)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5e0)::DOUBLE AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.5e0)::DOUBLE AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5e0)::DOUBLE AS tn FROM scores GROUP BY {KS})"""


@query("detection_metrics", f"""WITH {CONF} SELECT {KS}, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy,
  round({ba_sql()}, 6) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2, 6) AS f1_macro,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc,
  round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr, round(tn / (fp + tn), 6) AS tnr FROM conf""")
def detection_metrics(spark, d):
    """A11, A15."""
    s = X.scores(spark, d).withColumn("pred", C.predict("score", 0.5))
    return r6(C.detection_metrics(C.confusion(s, K)))


@query("rank_metrics", f"""WITH {SCORES}, t AS (SELECT {KS}, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scores GROUP BY {KS}, score),
c AS (SELECT *, sum(p) OVER w AS ctp, sum(n) OVER w AS cfp, sum(p) OVER a AS np, sum(n) OVER a AS nn, sum(p) OVER v AS lp, sum(n) OVER v AS ln FROM t
  WINDOW w AS (PARTITION BY {KS} ORDER BY score DESC), v AS (PARTITION BY {KS} ORDER BY score), a AS (PARTITION BY {KS}))
SELECT {KS}, max(np)::BIGINT AS n_pos, max(nn)::BIGINT AS n_neg, round(sum(p * (nn - cfp + 0.5e0 * n)) / (max(np)::DOUBLE * max(nn)), 6) AS roc_auc,
  round(sum(p / np::DOUBLE * (ctp / (ctp + cfp)::DOUBLE)), 6) AS pr_auc, round(sum(n / nn::DOUBLE * (ln / (ln + lp)::DOUBLE)), 6) AS pr_auc_benign FROM c GROUP BY {KS}""")
def rank_metrics(spark, d):
    """A16, A17, W17."""
    return r6(C.rank_metrics(X.scores(spark, d), K))


@query("brier", f"WITH {SCORES} SELECT {KS}, round(avg((greatest(least(score, 1e0), 0e0) - y) * (greatest(least(score, 1e0), 0e0) - y)), 6) AS brier FROM scores GROUP BY {KS}")
def brier(spark, d):
    """A18."""
    return r6(C.brier(X.scores(spark, d), K))


def _bins(n: int) -> str:
    from .registry import h
    return f"""{SCORES}, b AS (SELECT *, ntile({n}) OVER (PARTITION BY {KS} ORDER BY score, {h('row_id')}, row_id) - 1 AS bin FROM scores),
bins AS (SELECT {KS}, bin, avg(score) AS ms, avg(y) AS fr, count(*) AS n FROM b GROUP BY {KS}, bin)"""


@query("reliability_bins", f"WITH {_bins(15)} SELECT {KS}, bin::INT AS bin, round(ms, 6) AS mean_score, round(fr, 6) AS attack_freq, n FROM bins")
def reliability_bins(spark, d):
    """A20."""
    return r6(C.reliability_bins(X.scores(spark, d), K, ["row_id"]))


@query("ece", f"WITH {_bins(15)} SELECT {KS}, round(sum(n * abs(ms - fr)) / sum(n), 6) AS ece FROM bins GROUP BY {KS}")
def ece(spark, d):
    """A19."""
    return r6(C.ece(X.scores(spark, d), K, ["row_id"]))


@query("rebin_weighted", f"""WITH {_bins(15)}, c AS (SELECT *, least(floor(sum(n) OVER (PARTITION BY {KD} ORDER BY ms, split_seed, bin) / (sum(n) OVER (PARTITION BY {KD}))::DOUBLE * 15), 14)::INT AS grp_bin FROM bins)
SELECT {KD}, grp_bin, round(sum(ms * n) / sum(n), 6) AS mean_score, round(sum(fr * n) / sum(n), 6) AS attack_freq, sum(n)::BIGINT AS n FROM c GROUP BY {KD}, grp_bin""")
def rebin_weighted(spark, d):
    """A21."""
    b = C.reliability_bins(X.scores(spark, d), K, ["row_id"])
    return r6(C.rebin_weighted(b, ["model", "domain"], ["split_seed", "bin"]))


@query("per_category_recall", f"""WITH {SCORES} SELECT {KS}, category, round(avg(CASE WHEN category = 'benign' THEN 1 - (score >= 0.5e0)::INT ELSE (score >= 0.5e0)::INT END), 6) AS detection, count(*) AS n
FROM scores GROUP BY {KS}, category""")
def per_category_recall(spark, d):
    """A14."""
    return r6(C.per_category_recall(X.scores(spark, d), K))


@query("per_category_wide", f"""WITH {SCORES}, r AS (SELECT {KS}, category, avg(CASE WHEN category = 'benign' THEN 1 - (score >= 0.5e0)::INT ELSE (score >= 0.5e0)::INT END) AS v FROM scores GROUP BY {KS}, category)
SELECT {KS}, {', '.join(f"round(max(v) FILTER (WHERE category = '{c}'), 6) AS {c}" for c in ['benign'] + [f'attack_{i}' for i in range(1, 8)])} FROM r GROUP BY {KS}""")
def per_category_wide(spark, d):
    """A14, pivot form."""
    rec = C.per_category_recall(X.scores(spark, d), K)
    return r6(C.per_category_wide(rec, K, ["benign"] + [f"attack_{i}" for i in range(1, 8)]))


VIEWS = f"""{SCORES}, v AS (SELECT model, split_seed, "domain", "view", CASE WHEN is_copy THEN "file" || '|c' ELSE "file"::VARCHAR END AS cl, score,
  CASE WHEN "view" = 'relab' AND is_copy THEN 1 ELSE y END AS y FROM scores, (SELECT unnest(['all', 'clean', 'relab']) AS "view")
  WHERE NOT ("view" = 'clean' AND is_copy) AND ("domain" = 'target' OR "view" = 'all'))"""


def _views(spark, d):
    s = X.scores(spark, d).withColumn("cl", C.tag_copies(F.col("file").cast("string"), "is_copy"))
    return C.views(s, ["target"])


@query("views_counts", f"""WITH {VIEWS}, {counts_sql('model, split_seed, "domain", "view", cl', 'v')}
SELECT model, split_seed, "domain", "view", split_part(cl, '|', 1) AS cluster, tau, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn
FROM counts GROUP BY model, split_seed, "domain", "view", split_part(cl, '|', 1), tau""")
def views_counts(spark, d):
    """The consolidated counts of every view by base cluster."""
    c = C.counts_at(_views(spark, d), C.TAU_GRID, K + ["view", "cl"])
    return c.groupBy(*K, "view", C.base_cluster("cl").alias("cluster"), "tau").agg(*[F.sum(x).alias(x) for x in C.CELLS])


@query("consolidated_runs", f"""WITH {VIEWS}, c AS (SELECT model, split_seed, "domain", "view", count(*) AS n_eval, count(*) FILTER (WHERE y = 1 AND score >= 0.5e0) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5e0) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.5e0) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5e0) AS tn FROM v GROUP BY model, split_seed, "domain", "view")
SELECT model, split_seed, "domain", "view", n_eval, round({ba_sql()}, 6) AS balanced_accuracy, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr FROM c""")
def consolidated_runs(spark, d):
    """Runs of every view from stored scores."""
    v = _views(spark, d).withColumn("pred", C.predict())
    m = C.detection_metrics(C.confusion(v, K + ["view"]))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return r6(m.select(*K, "view", n.alias("n_eval"), "balanced_accuracy", "fpr"))


@query("training_label_variants", f"""WITH {LI}, v AS (SELECT 'clean' AS variant, y FROM li WHERE NOT is_copy UNION ALL SELECT 'relab', CASE WHEN is_copy THEN 1 ELSE y END FROM li)
SELECT variant, count(*) AS n, sum(y)::BIGINT AS attacks FROM v GROUP BY variant""")
def training_label_variants(spark, d):
    """P22."""
    li = X.lineitem(spark, d)
    parts = [C.training_labels(li, v).agg(F.lit(v).alias("variant"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("attacks")) for v in ("clean", "relab")]
    return parts[0].unionByName(parts[1])


@query("ppv_band", f"""WITH {POOLED}, g AS (SELECT *, {ppv_sql('tpr', 'fpr')} AS ppv FROM pooled WHERE tpr >= 0.1e0)
SELECT "domain", tau, round(min(ppv), 6) AS ppv_min, round(max(ppv), 6) AS ppv_max FROM g GROUP BY "domain", tau""")
def ppv_band(spark, d):
    """A50."""
    p = _pooled(spark, d).withColumn("ppv", S.ppv("tpr", "fpr")).filter(F.col("tpr") >= S.MIN_RECALL)
    return r6(C.range_band(p, ["domain", "tau"], "ppv"))


@query("runs_summary", f"""WITH {CONF}, r AS (SELECT {KS}, {ba_sql()} AS ba, fp / (fp + tn) AS fpr FROM conf)
SELECT {KD}, count(*) AS n, round(avg(ba), 6) AS ba_mean, round(stddev_samp(ba), 6) AS ba_sd, round(min(ba), 6) AS ba_min, round(max(ba), 6) AS ba_max,
  round(avg(fpr), 6) AS fpr_mean, round(stddev_samp(fpr), 6) AS fpr_sd, round(min(fpr), 6) AS fpr_min, round(max(fpr), 6) AS fpr_max FROM r GROUP BY {KD}""")
def runs_summary(spark, d):
    """A54."""
    c = _counts(spark, d).filter(S.same_tau("tau", 0.5)).withColumn("ba", S.balanced_accuracy()).withColumn("fpr", S.fpr())
    return r6(C.summarise_runs(c, ["model", "domain"], ["ba", "fpr"]))


@query("pi_star", f"""WITH {POOLED}, b AS (SELECT {KD}, max({ppv_sql('tpr', 'fpr')}) AS p FROM pooled WHERE tpr >= 0.5e0 GROUP BY {KD}),
o AS (SELECT {KD}, p, (0.1e0 / (1e0 - 0.1e0)) / (p / (1e0 - p) * ((1e0 - 0.002e0) / 0.002e0)) AS o FROM b WHERE p < 1)
SELECT {KD}, round(o / (1e0 + o), 6) AS pi_star FROM o""")
def pi_star(spark, d):
    """O9."""
    o = B.oracle_alert(_pooled(spark, d), ["model", "domain"]).filter(F.col("best_ppv") < 1)
    return r6(o.select("model", "domain", S.pi_star("best_ppv").alias("pi_star")))


@query("chance_floor", f"""WITH {SCORES}, p AS (SELECT "domain", avg(y) AS p FROM scores GROUP BY "domain")
SELECT "domain", round((p / (p + 0.5e0) + (1 - p) / ((1 - p) + 0.5e0)) / 2, 6) AS chance_macro_f1, round(225e0 * p, 6) AS scaled FROM p""")
def chance_floor(spark, d):
    """I23, O19."""
    p = X.scores(spark, d).groupBy("domain").agg(F.avg("y").alias("p"))
    return r6(p.select("domain", S.chance_macro_f1("p").alias("chance_macro_f1"), B.per_ue_hour("p").alias("scaled")))
