"""Alert burden: what an operating point means at a declared base rate."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import counts as C
from . import inference as I

# The swept prevalences and benign arrival rates.
PI_SWEEP = [1e-4, 5e-4, 1e-3, 2e-3, 5e-3, 1e-2, 5e-2, 0.1, 0.2, 0.5]
LAMBDA_SWEEP = [24_000.0, 240_000.0, 2_400_000.0, 24_000_000.0]


def rates(counts: DataFrame, pi: float = S.PI) -> DataFrame:
    """O1. recall, fpr, precision, PPV at pi, false alerts per hour, BA."""
    d = counts.withColumn("recall", S.recall()).withColumn("fpr", S.fpr())
    return (d.withColumn("corpus_precision", S.precision())
            .withColumn("ppv", S.ppv("recall", "fpr", pi))
            .withColumn("alerts_per_h", S.LAMBDA_B * F.col("fpr"))
            .withColumn("ba", 0.5 * (F.col("recall") + 1.0 - F.col("fpr"))))


def operational(df: DataFrame, tpr: str = "tpr", fpr: str = "fpr", pi: str = "pi",
                lam: str = "lambda_b") -> DataFrame:
    """O2. Alerts per hour and day, true, false, per 100k benign, PPV, NPV, FDR, missed."""
    t, f, p, l = (F.col(c) for c in (tpr, fpr, pi, lam))
    ratio = p / F.greatest(1.0 - p, F.lit(1e-12))
    la = l * ratio
    tp, fp = t * la, f * l
    fn, tn = (1.0 - t) * la, (1.0 - f) * l
    v = F.try_divide(tp, tp + fp)
    return df.select(
        "*", v.alias("ppv"), F.try_divide(tn, tn + fn).alias("npv"), (1.0 - v).alias("fdr"),
        (tp + fp).alias("alerts_per_hour"), tp.alias("true_alerts_per_hour"),
        fp.alias("false_alerts_per_hour"), ((tp + fp) * 24.0).alias("alerts_per_day"),
        (f * 1e5 + t * 1e5 * ratio).alias("alerts_per_100k_benign"),
        fn.alias("missed_attacks_per_hour"))


def cross_grid(df: DataFrame, **grids: list[float]) -> DataFrame:
    """J13. Operating points times literal parameter grids, as a row generator."""
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df


def pi_lambda_grid(points: DataFrame, pis=PI_SWEEP, lambdas=LAMBDA_SWEEP) -> DataFrame:
    """J13 + O2 on pooled operating points with Wilson ends."""
    g = operational(cross_grid(points, pi=pis, lambda_b=lambdas))
    return (g.withColumn("ppv_lo", S.ppv("tpr_lo", "fpr_hi", F.col("pi")))
            .withColumn("ppv_hi", S.ppv("tpr_hi", "fpr_lo", F.col("pi"))))


def prevalence_sweep(points: DataFrame, keys: list[str] = (), pis=PI_SWEEP) -> DataFrame:
    """O4. PPV range, spread and mean collapse over the models at each pi."""
    g = cross_grid(points, pi=pis).withColumn("_v", S.ppv("tpr", "fpr", F.col("pi")))
    return g.groupBy(*keys, "pi").agg(
        F.min("_v").alias("ppv_min"), F.max("_v").alias("ppv_max"),
        F.try_divide(F.max("_v"), F.min("_v")).alias("spread"),
        F.avg(F.try_divide(F.col("corpus_precision"), F.col("_v"))).alias("collapse_mean"))


def ppv_bounds(points: DataFrame, pi: float = S.PI) -> DataFrame:
    """O4. Best and worst case PPV from the Wilson ends of the FPR, and the collapse factor."""
    return (points.withColumn("ppv", S.ppv("tpr", "fpr", pi))
            .withColumn("ppv_best_case", S.ppv("tpr", "fpr_lo", pi))
            .withColumn("ppv_worst_case", S.ppv("tpr", "fpr_hi", pi))
            .withColumn("collapse", F.try_divide(F.col("corpus_precision"), F.col("ppv"))))


def ppv_reachability(pooled: DataFrame, keys: list[str], floor: float = S.MIN_RECALL,
                     targets=(0.01, 0.05, 0.10), pi: float = S.PI) -> DataFrame:
    """O7. Best PPV with recall above the floor, and the first tau for each target.

    Keys that never reach the floor keep a row with NULLs.
    """
    g = pooled.withColumn("ppv", S.ppv("tpr", "fpr", pi)) \
        .withColumn("ppv_worst", S.ppv("tpr", "fpr_hi", pi))
    ok = F.col("tpr") >= floor
    # ties of the best PPV go to the smallest tau
    best = F.max(F.when(ok & F.col("ppv").isNotNull(), F.struct(
        F.col("ppv"), (-F.col("tau")).alias("nt"), "tpr", "fpr", "fp",
        (F.col("fp") + F.col("tn")).alias("n_benign"), "ppv_worst")))
    aggs = [best.alias("_b")]
    for t in targets:
        hit = F.when(ok & (F.col("ppv") >= t), F.struct("tau", "tpr"))
        aggs.append(F.min(hit).alias(f"_h{t}"))
    r = g.groupBy(*keys).agg(*aggs)
    cols = [F.col("_b.ppv").alias("ppv_max"), (-F.col("_b.nt")).alias("tau_at_max"),
            F.col("_b.tpr").alias("tpr_at_max"), F.col("_b.fpr").alias("fpr_at_max"),
            F.col("_b.fp").alias("fp_at_max"), F.col("_b.n_benign").alias("n_benign"),
            F.col("_b.ppv_worst").alias("ppv_worst_at_max")]
    for t in targets:
        n = f"{int(round(t * 100)):02d}"
        cols += [F.col(f"`_h{t}`.tau").alias(f"tau_for_ppv_{n}"),
                 F.col(f"`_h{t}`.tpr").alias(f"tpr_for_ppv_{n}")]
    return r.select(*keys, *cols)


def ppv_crossings(df: DataFrame, keys: list[str], bars=(0.1, 0.25, 0.5)) -> DataFrame:
    """O6. Smallest tau with mean PPV >= bar, recall and alerts there, else unreachable.

    `df` has one row per (keys, split, tau) with ppv, recall and alerts_per_hour; the
    three are averaged over splits first.
    """
    a = df.groupBy(*keys, "tau").agg(F.avg("ppv").alias("ppv"), F.avg("recall").alias("recall"),
                                     F.avg("alerts_per_hour").alias("alerts"))
    a = cross_grid(a, ppv_bar=list(bars))
    hit = F.min(F.when(F.col("ppv") >= F.col("ppv_bar"), F.struct("tau", "recall", "alerts")))
    r = a.groupBy(*keys, "ppv_bar").agg(hit.alias("_h"))
    return r.select(*keys, "ppv_bar", F.col("_h").isNotNull().cast("int").alias("reachable"),
                    F.col("_h.tau").alias("tau"), F.col("_h.recall").alias("recall_there"),
                    F.col("_h.alerts").alias("alerts_there"))


def pi_required(grid: DataFrame, keys: list[str], bars=(0.25, 0.5, 0.9)) -> DataFrame:
    """O8. Smallest swept pi with PPV >= bar."""
    g = cross_grid(grid, ppv_bar=list(bars))
    r = g.groupBy(*keys, "ppv_bar").agg(
        F.min(F.when(F.col("ppv") >= F.col("ppv_bar"), F.col("pi"))).alias("pi_required"))
    return r.withColumn("reachable", F.col("pi_required").isNotNull().cast("int"))


def separability(grid: DataFrame, keys: list[str], lam0: float = S.LAMBDA_B) -> DataFrame:
    """A52. Variation of PPV across lambda; deviation of the alerts from linearity."""
    k = [*keys, "pi"]
    base = F.max(F.when(F.col("lambda_b") == lam0, F.col("alerts_per_hour"))).over(
        Window.partitionBy(*k))
    g = grid.withColumn("_dev", F.abs(F.col("alerts_per_hour") - base * (F.col("lambda_b") / lam0)))
    per = g.groupBy(*k).agg((F.max("ppv") - F.min("ppv")).alias("_v"), F.max("_dev").alias("_d"))
    return per.agg(F.max("_v").alias("max_ppv_variation"), F.max("_d").alias("max_linearity_dev"))


def ppv_spread(grid: DataFrame, surface: list[str], lam0: float = S.LAMBDA_B) -> DataFrame:
    """A53. Per (surface, pi): PPV range over models, collapse factor, best model."""
    g = grid.filter((F.col("lambda_b") == lam0) & (F.col("ppv") > 0))
    r = g.groupBy(*surface, "pi").agg(
        F.count(F.lit(1)).alias("n_models"), F.min("ppv").alias("ppv_min"),
        F.max("ppv").alias("ppv_max"),
        (F.max("corpus_precision") - F.min("corpus_precision")).alias("corpus_precision_range"),
        (F.avg("corpus_precision") / F.avg("ppv")).alias("collapse_factor"),
        F.max(F.struct("ppv", "model")).getField("model").alias("best_model"),
        F.expr("percentile(false_alerts_per_hour, 0.5)").alias("false_alerts_median"))
    return r.filter(F.col("n_models") >= 2).withColumn("ppv_ratio", F.col("ppv_max") / F.col("ppv_min"))


def source_thresholds(counts: DataFrame, keys: list[str], r_min: float = S.R_MIN) -> DataFrame:
    """O10. Largest tau with source recall >= r_min, else the smallest tau."""
    t = counts.groupBy(*keys, "tau").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))
    return t.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(S.recall() >= r_min, F.col("tau"))), F.min("tau")).alias("tau_star"))


def at_threshold(counts: DataFrame, tau_star: DataFrame, on: list[str],
                 keys: list[str]) -> DataFrame:
    """T8. Counts at the grid tau nearest to each key's tau_star (ties to the smaller)."""
    t = counts.groupBy(*dict.fromkeys([*keys, *on]), "tau").agg(*[F.sum(c).alias(c) for c in C.CELLS])
    t = t.join(tau_star.select(*on, "tau_star"), on)
    gap = F.abs(F.col("tau") - F.col("tau_star"))
    best = F.min(F.struct(gap.alias("gap"), "tau", *C.CELLS)).alias("_b")
    r = t.groupBy(*dict.fromkeys([*keys, *on]), "tau_star").agg(best)
    return r.select(*dict.fromkeys([*keys, *on]), "tau_star", F.col("_b.tau").alias("tau"),
                    *[F.col(f"_b.{c}").alias(c) for c in C.CELLS])


def _rate_intervals(per_split: DataFrame, keys: list[str], ratio: float | Column,
                    extra: list[Column] = ()) -> DataFrame:
    """Mean recall and fpr over splits, clipped corrected intervals, implied PPV ends."""
    r = I.nb_intervals(per_split, keys, ["recall", "fpr"], ratio, extra=list(extra))
    for m in ("recall", "fpr"):
        r = (r.withColumnRenamed(f"{m}_mean", m)
             .withColumn(f"{m}_lo", F.greatest(F.lit(0.0), F.col(f"{m}_nb_lo")))
             .withColumn(f"{m}_hi", F.least(F.lit(1.0), F.col(f"{m}_nb_hi"))))
    for e in ("", "_lo", "_hi"):
        r = r.withColumn(f"alerts_per_h{e}", S.LAMBDA_B * F.col(f"fpr{e}"))
    r = (r.withColumn("ppv", S.ppv("recall", "fpr")).withColumn("ppv_lo", S.ppv("recall_lo", "fpr_hi"))
         .withColumn("ppv_hi", F.when((F.col("fpr_lo") == 0) & (F.col("recall_hi") > 0), 1.0)
                     .otherwise(S.ppv("recall_hi", "fpr_lo"))))
    drop = [f"{m}_{s}" for m in ("recall", "fpr")
            for s in ("nb_lo", "nb_hi", "t_lo", "t_hi", "sd", "t_nb", "t_t")]
    return r.drop(*drop)


def alert_term(at: DataFrame, keys: list[str], ratio: float | Column) -> DataFrame:
    """O11. Target operating point at each split's own source threshold, three outcomes.

    Recall and FPR are averaged over splits; PPV and alerts follow from the mean rates
    and their interval ends, never from averaging PPV.
    """
    p = rates(at)
    met = (F.col("recall") >= S.R_MIN) & (F.col("alerts_per_h") <= S.A_MAX) & (F.col("ppv") >= S.RHO)
    r = _rate_intervals(p, keys, ratio, [
        F.min("tau_star").alias("tau_star_min"), F.max("tau_star").alias("tau_star_max"),
        F.count_if(met).alias("splits_meeting_all")])
    r = (r.withColumn("recall_outcome", S.tri("recall_lo", "recall_hi", S.R_MIN, False))
         .withColumn("alerts_outcome", S.tri("alerts_per_h_lo", "alerts_per_h_hi", S.A_MAX, True))
         .withColumn("ppv_outcome", S.tri("ppv_lo", "ppv_hi", S.RHO, False)))
    return r.withColumn("alert_term", S.combine("recall_outcome", "alerts_outcome", "ppv_outcome"))


def pooled_operating_point(counts: DataFrame, keys: list[str], split: str, ratio: float | Column,
                           tau: float = 0.5) -> DataFrame:
    """O12. Per-split rates at one tau with corrected intervals, beside the pooled rates."""
    at = counts.filter(S.same_tau("tau", tau)).groupBy(*keys, split).agg(
        *[F.sum(c).alias(c) for c in C.CELLS])
    tot = [F.sum(c).alias(f"_{c}") for c in C.CELLS]
    r = _rate_intervals(rates(at), keys, ratio, tot)
    return (r.withColumn("pooled_recall", S.recall("_tp", "_fn"))
            .withColumn("pooled_fpr", S.fpr("_fp", "_tn"))
            .withColumn("corpus_precision", S.precision("_tp", "_fp"))
            .drop(*[f"_{c}" for c in C.CELLS]))


def oracle_alert(pooled: DataFrame, keys: list[str], r_min: float = S.R_MIN) -> DataFrame:
    """O13. Target-searched bound: best PPV and fewest alerts with recall >= r_min."""
    p = rates(pooled)
    ok = F.col("recall") >= r_min
    best = F.max(F.when(ok & F.col("ppv").isNotNull(),
                        F.struct("ppv", (-F.col("tau")).alias("nt"))))
    few = F.min(F.when(ok & F.col("alerts_per_h").isNotNull(),
                       F.struct("alerts_per_h", "tau", "recall")))
    floor = F.max(F.when(F.col("recall") >= S.MIN_RECALL, F.col("ppv")))
    r = p.groupBy(*keys).agg(best.alias("_b"), few.alias("_f"), floor.alias("best_ppv_r10"))
    return r.select(*keys, F.col("_b.ppv").alias("best_ppv"), (-F.col("_b.nt")).alias("tau_best_ppv"),
                    F.col("_f.alerts_per_h").alias("min_alerts"),
                    F.col("_f.tau").alias("tau_min_alerts"),
                    F.col("_f.recall").alias("recall_at_min_alerts"), "best_ppv_r10")


def deployability_test(gen: DataFrame, alert: DataFrame, keys: list[str]) -> DataFrame:
    """O15. Verdict of the generalisation interval and the alert term."""
    d = gen.join(alert, keys).withColumn("generalization", S.tri("nb_lo", "nb_hi", S.DELTA, True))
    return d.withColumn("verdict", S.combine("generalization", "alert_term"))


def predicate(gen_upper: DataFrame, pooled: DataFrame, keys: list[str]) -> DataFrame:
    """O15, earlier form: upper end of the loss, and some tau meeting all three bounds."""
    p = rates(pooled).filter(F.col("recall") >= S.R_MIN)
    hit = (F.col("ppv") >= S.RHO) & (F.col("alerts_per_h") <= S.A_MAX)
    a = p.groupBy(*keys).agg(F.max("ppv").alias("best_ppv_at_rmin"),
                             F.min("alerts_per_h").alias("min_false_alerts_at_rmin"),
                             F.max(hit.cast("int")).alias("alert_pass"))
    d = gen_upper.join(a, keys, "left").withColumn("alert_pass", F.coalesce("alert_pass", F.lit(0)))
    d = d.withColumn("gen_pass", (F.col("upper") <= S.DELTA).cast("int"))
    return d.withColumn("verdict", F.col("gen_pass") * F.col("alert_pass"))


def published_ladder(runs: DataFrame, keys=("rung", "feature_set", "model"), first: str = "R0") -> DataFrame:
    """O16. Pooled PPV and alerts per rung, BA drop from the first rung, verdict on all and clean rows."""
    g = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("balanced_accuracy").alias("ba"),
        F.avg("clean_balanced_accuracy").alias("ba_clean"),
        *[F.sum(c).alias(c) for c in C.CELLS], *[F.sum(f"clean_{c}").alias(f"clean_{c}") for c in C.CELLS])
    r0 = g.filter(F.col("rung") == first).groupBy("model").agg(
        F.max("ba").alias("_ba0"), F.max("ba_clean").alias("_bc0"))
    d = g.join(r0, "model", "left")
    d = d.withColumn("ba_drop_from_r0", F.col("_ba0") - F.col("ba")) \
        .withColumn("clean_ba_drop_from_r0", F.col("_bc0") - F.col("ba_clean")).drop("_ba0", "_bc0")
    for pre in ("", "clean_"):
        d = (d.withColumn(f"{pre}tpr", S.recall(f"{pre}tp", f"{pre}fn"))
             .withColumn(f"{pre}fpr", S.fpr(f"{pre}fp", f"{pre}tn"))
             .withColumn(f"{pre}ppv", S.ppv(f"{pre}tpr", f"{pre}fpr"))
             .withColumn(f"{pre}fa_h", S.LAMBDA_B * F.col(f"{pre}fpr")))
        ok = (F.col(f"{pre}tpr") >= S.R_MIN) & (F.col(f"{pre}ppv") >= S.RHO) & (F.col(f"{pre}fa_h") <= S.A_MAX)
        gen = F.col(f"{pre}ba_drop_from_r0") <= S.DELTA
        d = d.withColumn(f"{pre}verdict", F.coalesce((ok & gen).cast("int"), F.lit(0)))
    return d


def alert_grid(pooled: DataFrame, a_max: list[float], rhos: list[float],
               keys: list[str] = (), r_min: float = S.R_MIN) -> DataFrame:
    """O17. Number of models with some tau inside each (A_max, rho) bound."""
    p = rates(pooled).filter(F.col("recall") >= r_min)
    g = cross_grid(p, a_max=a_max, rho=rhos)
    ok = (F.col("ppv") >= F.col("rho")) & (F.col("alerts_per_h") <= F.col("a_max"))
    per = g.groupBy(*keys, "a_max", "rho", "model").agg(F.max(ok.cast("int")).alias("_ok"))
    return per.groupBy(*keys, "a_max", "rho").agg(F.sum("_ok").alias("n_models"))


def label_efficient_curve(runs: DataFrame, counts: DataFrame, keys: list[str], source: str,
                          target: str) -> DataFrame:
    """O18. Per key: BA over draws, and the point at each draw's own source threshold.

    `runs` and `counts` carry (keys…, draw, domain); a draw without a source fold uses 0.5.
    """
    k = [*keys, "draw"]
    src = source_thresholds(counts.filter(F.col("domain") == source), k)
    tgt = counts.filter(F.col("domain") == target)
    stars = tgt.select(*k).distinct().join(src, k, "left") \
        .withColumn("tau_star", F.coalesce("tau_star", F.lit(0.5)))
    at = rates(at_threshold(tgt, stars, k, k))
    op = at.groupBy(*keys).agg(
        F.avg("fpr").alias("fpr_at_tau_star"), F.avg("recall").alias("recall_at_tau_star"),
        F.avg("alerts_per_h").alias("alerts_at_tau_star"),
        F.count_if((F.col("alerts_per_h") <= S.A_MAX) & (F.col("recall") >= S.R_MIN))
        .alias("draws_meeting_alert_bound"))
    ba = runs.filter(F.col("domain") == target).groupBy(*keys).agg(
        F.count_distinct("draw").alias("draws"), F.avg("balanced_accuracy").alias("ba"),
        F.min("balanced_accuracy").alias("ba_min"), F.max("balanced_accuracy").alias("ba_max"))
    return ba.join(op, keys)


def per_ue_hour(fpr: str | Column = "fpr") -> Column:
    """O19. False alerts per benign UE-hour."""
    return S.as_col(fpr) * F.lit(float(S.WINDOWS_PER_UE_HOUR))


def deployability_matrix(base: DataFrame, axes: list[DataFrame], on: str = "model") -> DataFrame:
    """O20. One row per model, one column per axis; an axis that was not measured is NULL."""
    for a in axes:
        base = base.join(a, on, "left")
    return base
