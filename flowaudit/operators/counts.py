"""Scores to confusion counts, and metrics from counts.

The counts table `(keys…, tau, tp, fp, fn, tn)` is what every later statistic reads.
"""
from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S

# The two threshold grids of the evaluation.
TAU_GRID = [round(0.05 * i, 4) for i in range(1, 20)] + [0.975, 0.99, 0.995, 0.999]
TAU_FINE = sorted({round(i / 200.0, 8) for i in range(201)}
                  | {round(1.0 - 10.0 ** (-6.0 + 4.0 * i / 24.0), 8) for i in range(25)})
CELLS = ("tp", "fp", "fn", "tn")


# ----------------------------------------------------------------- views
def views(df: DataFrame, domains: list[str] | None = None, copy: str = "is_copy",
          y: str = "y", domain: str = "domain") -> DataFrame:
    """P21. One row per view: all, clean (copies dropped), relab (copies positive).

    Domains outside `domains` have no flagged copies and keep the view `all` only.
    """
    all_views = F.array(*[F.lit(v) for v in ("all", "clean", "relab")])
    vs = all_views if domains is None else \
        F.when(F.col(domain).isin(domains), all_views).otherwise(F.array(F.lit("all")))
    out = df.withColumn("view", F.explode(vs))
    out = out.filter(~((F.col("view") == "clean") & F.col(copy)))
    return out.withColumn(y, F.when((F.col("view") == "relab") & F.col(copy), F.lit(1))
                          .otherwise(F.col(y)))


def training_labels(df: DataFrame, variant: str, copy: str = "is_copy", y: str = "y") -> DataFrame:
    """P22. The training pool under a label variant."""
    if variant == "clean":
        return df.filter(~F.col(copy))
    if variant == "relab":
        return df.withColumn(y, F.when(F.col(copy), F.lit(1)).otherwise(F.col(y)))
    raise ValueError(f"unknown label variant {variant!r}")


def tag_copies(grp: str | Column = "grp", flag: str | Column = "is_copy") -> Column:
    """P24. Append '|c' to the group of flagged rows."""
    g = S.as_col(grp)
    return F.when(S.as_col(flag), F.concat(g, F.lit("|c"))).otherwise(g)


def base_cluster(grp: str | Column = "grp") -> Column:
    """P23. '5|c' -> '5'."""
    return F.split_part(S.as_col(grp), F.lit("|"), F.lit(1))


# ---------------------------------------------------------------- counts
def predict(score: str | Column = "score", tau: float = 0.5) -> Column:
    """P25. Positive iff score >= tau."""
    return (S.as_col(score) >= F.lit(tau)).cast("int")


def confusion(df: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """A11. tp, fp, fn, tn of a prediction column."""
    yy, p = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*keys).agg(
        F.count_if(yy & p).alias("tp"), F.count_if(~yy & p).alias("fp"),
        F.count_if(yy & ~p).alias("fn"), F.count_if(~yy & ~p).alias("tn"))


def counts_at(df: DataFrame, taus: list[float], keys: list[str], score: str = "score",
              y: str = "y") -> DataFrame:
    """A12, A13. Counts at every threshold, one pass over the scores.

    A score falls into the slot of the largest tau not above it; the map side keeps
    one row per (keys, slot). The running sums from the top slot down are the counts.
    """
    taus = sorted(taus)
    b = Bucketizer(splits=[-float("inf")] + taus + [float("inf")], inputCol="_s",
                   outputCol="_b", handleInvalid="error")
    d = b.transform(df.select(*keys, F.col(y).alias("_y"), F.col(score).cast("double").alias("_s")))
    slot = d.groupBy(*keys, F.col("_b").cast("int").alias("_slot")).agg(
        F.count_if(F.col("_y") == 1).alias("_p"), F.count_if(F.col("_y") == 0).alias("_n"))
    w = Window.partitionBy(*(keys or [F.lit(0)]))
    down = w.orderBy(F.col("_slot").desc())
    run = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = slot.select(*keys, "_slot", F.sum("_p").over(run).alias("_tp"), F.sum("_n").over(run).alias("_fp"),
                    F.sum("_p").over(w).alias("_np"), F.sum("_n").over(w).alias("_nn"),
                    F.coalesce(F.lead("_slot").over(down), F.lit(0)).alias("_low"), F.lag("_slot").over(down).isNull().alias("_top"))
    # a slot answers the thresholds down to the next slot with rows; the top slot also those above it, with nothing
    lo, hi = F.col("_low") + 1, F.when(F.col("_top"), len(taus)).otherwise(F.col("_slot"))
    out = r.withColumn("_i", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    hit = lambda c: F.when(F.col("_i") <= F.col("_slot"), F.col(c)).otherwise(F.lit(0))        # noqa: E731
    return out.select(*keys, F.element_at(F.array(*[F.lit(t) for t in taus]), F.col("_i")).alias("tau"), hit("_tp").alias("tp"),
                      hit("_fp").alias("fp"), "_np", "_nn") \
        .select(*keys, "tau", "tp", "fp", (F.col("_np") - F.col("tp")).alias("fn"),
                (F.col("_nn") - F.col("fp")).alias("tn"))


def densify(counts: DataFrame, taus: list[float], keys: list[str], cluster: str) -> DataFrame:
    """J14. Every (keys, cluster, tau) present, absent cells 0. The grid is a literal.

    The cells of a cluster are gathered, and the thresholds without one are added where they are.
    """
    by = [*keys, cluster]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])          # a NULL key meets no cell
    zero = [F.lit(0).cast(counts.schema[c].dataType) for c in CELLS]
    cell = F.struct(F.col("tau").cast("double").alias("tau"), *[F.coalesce(F.col(c), z).alias(c) for c, z in zip(CELLS, zero)])
    g = counts.groupBy(*by).agg(F.collect_list(F.when(known & F.col("tau").isin(taus), cell)).alias("_c"))
    absent = F.array_except(F.array(*[F.lit(float(t)) for t in taus]), F.col("_c.tau"))
    rest = F.transform(absent, lambda t: F.struct(t.alias("tau"), *[z.alias(c) for c, z in zip(CELLS, zero)]))
    return g.select(*by, F.explode(F.concat("_c", rest)).alias("_x")).select(*by, "_x.*")


def pool_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A22. Counts summed over splits, then rates and Wilson ends."""
    g = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in CELLS])
    g = (g.withColumn("tpr", S.recall()).withColumn("fpr", S.fpr())
         .withColumn("corpus_precision", S.precision()))
    n_neg, n_pos = F.col("fp") + F.col("tn"), F.col("tp") + F.col("fn")
    return (g.withColumn("fpr_lo", S.wilson("fp", n_neg, False))
            .withColumn("fpr_hi", S.wilson("fp", n_neg, True))
            .withColumn("tpr_lo", S.wilson("tp", n_pos, False))
            .withColumn("tpr_hi", S.wilson("tp", n_pos, True)))


def fold_spread(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A23. Spread of the fold false-positive rates and the pooled LR+."""
    neg = F.col("fp") + F.col("tn")
    f = counts.withColumn("_f", F.col("fp") / F.greatest(neg, F.lit(1))).withColumn("_neg", neg)
    g = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_folds"), F.min("_f").alias("fold_fpr_min"),
        F.expr("percentile(_f, 0.5)").alias("fold_fpr_median"), F.max("_f").alias("fold_fpr_max"),
        F.count_if(F.col("fp") == 0).alias("n_folds_with_zero_fp"),
        F.expr("percentile(_neg, 0.5)").alias("benign_per_fold_median"),
        *[F.sum(c).alias(c) for c in CELLS])
    return g.withColumn("lr_plus", F.try_divide(S.recall(), S.fpr())).drop(*CELLS)


def estimator_contrast(counts: DataFrame, keys: list[str], pi: float = S.PI) -> DataFrame:
    """A24. Pooled PPV beside the mean and the median of the fold PPVs."""
    f = counts.withColumn("_ppv", S.ppv(S.recall(), S.fpr(), pi))
    g = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"), F.count_if(F.col("fp") == 0).alias("folds_fpr_zero"),
        F.count_if(F.col("_ppv") >= 0.999).alias("folds_ppv_one"),
        F.avg("_ppv").alias("mean_of_folds"),
        F.expr("percentile(_ppv, 0.5)").alias("median_of_folds"),
        *[F.sum(c).alias(c) for c in CELLS])
    return g.withColumn("pooled", S.ppv(S.recall(), S.fpr(), pi)).drop(*CELLS)


def estimator_spread(contrast: DataFrame, keys: list[str]) -> DataFrame:
    """A24. max/min over models of each estimator."""
    return contrast.groupBy(*keys).agg(*[
        F.try_divide(F.max(c), F.min(c)).alias(f"spread_{n}")
        for c, n in (("pooled", "pooled"), ("mean_of_folds", "mean"),
                     ("median_of_folds", "median"))])


# --------------------------------------------------------------- metrics
def detection_metrics(counts: DataFrame) -> DataFrame:
    """A15. Threshold metrics from counts. Zero divisions give 0, as for MCC of one class."""
    tp, fp, fn, tn = (S.dbl(c) for c in CELLS)
    one_class = ((tp + fn) == 0) | ((fp + tn) == 0)
    rec, spec = S.ratio(tp, tp + fn), S.ratio(tn, tn + fp)
    f1 = S.ratio0(2 * tp, 2 * tp + fp + fn)
    f1_neg = S.ratio0(2 * tn, 2 * tn + fp + fn)
    mcc_den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.select(
        "*",
        (S.ratio0(tp + tn, tp + tn + fp + fn)).alias("accuracy"),
        F.when(one_class, F.coalesce(rec, spec)).otherwise((rec + spec) / 2)
        .alias("balanced_accuracy"),
        S.ratio0(tp, tp + fp).alias("precision"), F.coalesce(rec, F.lit(0.0)).alias("recall"),
        f1.alias("f1"),
        # a class absent from both labels and predictions is no part of the mean
        F.when((tp + fp + fn) == 0, f1_neg).when((tn + fp + fn) == 0, f1)
        .otherwise((f1 + f1_neg) / 2).alias("f1_macro"),
        F.when(one_class, 0.0).otherwise(S.ratio0(tp * tn - fp * fn, mcc_den)).alias("mcc"),
        S.ratio0(fp, fp + tn).alias("fpr"), S.ratio0(fn, fn + tp).alias("fnr"),
        S.ratio0(tn, fp + tn).alias("tnr"))


def score_table(df: DataFrame, keys: list[str], score: str = "score", y: str = "y", freq: str | None = None) -> DataFrame:
    """Distinct scores with their class counts: repeated scores become one row. A row counts `freq` times."""
    n = lambda c: F.count_if(F.col(y) == c) if freq is None else F.sum(F.when(F.col(y) == c, F.col(freq)).otherwise(0))      # noqa: E731
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(n(1).alias("pos"), n(0).alias("neg"))


def table_metrics(table: DataFrame, keys: list[str], tau: float = 0.5) -> DataFrame:
    """A11, A18 of a score table: the counts at one threshold and the Brier score."""
    p, s = predict("score", tau) == 1, S.clip("score", 0.0, 1.0)
    cell = lambda c, at: F.coalesce(F.sum(F.when(at, F.col(c))), F.lit(0))           # noqa: E731
    sq = F.col("pos") * (s - 1.0) * (s - 1.0) + F.col("neg") * s * s
    return table.groupBy(*keys).agg(
        cell("pos", p).alias("tp"), cell("neg", p).alias("fp"), cell("pos", ~p).alias("fn"), cell("neg", ~p).alias("tn"),
        S.ratio(F.sum(sq), F.sum(F.when(sq.isNotNull(), F.col("pos") + F.col("neg")))).alias("brier"))


def cumulative_positive(df: DataFrame | None, keys: list[str], score: str = "score",
                        y: str = "y", table: DataFrame | None = None) -> DataFrame:
    """W17. Running tp and fp along descending score, per distinct score; `table` is a stored score table."""
    t = O.quantile_buckets(O.cached(score_table(df, keys, score, y)) if table is None else table, "score")
    t = t.withColumn(O.BUCKET, -F.col(O.BUCKET))
    out = O.running_sums(t, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")},
                         keys, totals=True)
    return out.drop(O.BUCKET)


def rank_metrics(df: DataFrame | None, keys: list[str], score: str = "score", y: str = "y",
                 table: DataFrame | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """A16, A17. Exact tie-averaged AUC, step average precision, and AP of the benign class.

    NULL for groups of one class. Both curves come from one cumulative table, and so do the
    aggregates `extra`. `table` is a stored score table, read in place of `df`.
    """
    c, extra = cumulative_positive(df, keys, score, y, table), extra or {}
    p, n = F.col("tp_all"), F.col("fp_all")
    prev_fp = F.col("fp") - F.col("neg")
    # pairs in which a positive outranks a negative, ties counted one half
    auc_part = F.col("pos") * ((n - F.col("fp")) + 0.5 * F.col("neg"))
    ap_part = S.ratio("pos", p) * F.try_divide(S.dbl("tp"), S.dbl(F.col("tp") + F.col("fp")))
    # benign as positive on 1 - score: the same table read from the low end
    low_neg = n - prev_fp
    low_pos = p - (F.col("tp") - F.col("pos"))
    apb_part = S.ratio("neg", n) * F.try_divide(S.dbl(low_neg), S.dbl(low_neg + low_pos))
    g = c.groupBy(*keys).agg(
        F.max("tp_all").alias("n_pos"), F.max("fp_all").alias("n_neg"),
        F.sum(auc_part).alias("_a"), F.sum(ap_part).alias("_p"), F.sum(apb_part).alias("_b"), *[e.alias(k) for k, e in extra.items()])
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return g.select(*keys, "n_pos", "n_neg",
                    F.when(both, S.ratio("_a", S.dbl("n_pos") * F.col("n_neg"))).alias("roc_auc"),
                    F.when(both, F.col("_p")).alias("pr_auc"),
                    F.when(both, F.col("_b")).alias("pr_auc_benign"), *extra)


def brier(df: DataFrame, keys: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """A18."""
    d = S.clip(score, 0.0, 1.0) - F.col(y)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("brier"))


def _bin_of(rank: Column, n: Column, n_bins: int) -> Column:
    """Bin of a 1-based rank: min(n_bins, n) bins, the first n mod k one row larger."""
    k = F.least(F.lit(n_bins).cast("long"), n)
    small, extra = F.floor(n / k), n % k
    head, pos = extra * (small + 1), rank - 1
    return F.when(pos < head, F.floor(pos / (small + 1))).otherwise(extra + F.floor((pos - head) / small)).cast("int")


def equal_mass_bins(df: DataFrame, n_bins: int, keys: list[str], tie: list[str],
                    score: str = "score") -> DataFrame:
    """Add `bin` to every row: equal-mass bins of the score, ties in the order of their hash."""
    d = O.value_rank(df, score, tie, keys, name="_rk")
    return d.withColumn("bin", _bin_of(F.col("_rk"), F.col("_rk_all"), n_bins)).drop("_rk", "_rk_all")


def bin_sums(df: DataFrame, keys: list[str], tie: list[str], n_bins: int = 15, score: str = "score",
             y: str = "y", table: DataFrame | None = None) -> DataFrame:
    """Sum of scores, attacks and rows of every equal-mass bin.

    Scores are summed as decimals of 12 places, so the sum does not depend on the order in
    which tasks deliver it.

    The bins come from the running counts of distinct scores. Only a repeated score that
    spans a bin edge needs the order of its rows, so only those rows are read again. `table` is
    a stored score table of `df`.
    """
    keys = list(keys)
    hist = O.quantile_buckets(O.cached(score_table(df, keys, score, y)) if table is None else table, "score")
    h = O.running_sums(hist, ["score"], {"_hi": F.col("pos") + F.col("neg")}, keys, totals=True).drop(O.BUCKET)
    n = F.col("pos") + F.col("neg")
    exact = lambda c: F.col(c).cast("decimal(18,12)")                      # noqa: E731
    h = h.withColumn("_b", _bin_of(F.col("_hi") - n + 1, F.col("_hi_all"), n_bins)) \
        .withColumn("_e", _bin_of(F.col("_hi"), F.col("_hi_all"), n_bins))
    h = O.cached(h)
    whole = h.filter(F.col("_b") == F.col("_e")).select(*keys, F.col("_b").alias("bin"), (exact("score") * n.cast("decimal(18,0)")).alias("_s"),
                                                      F.col("pos").alias("_p"), n.alias("n"))
    edge = h.filter(F.col("_b") < F.col("_e")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("score").alias("_v"), (F.col("_hi") - n).alias("_lo"), F.col("_hi_all").alias("_n"))
    cond = F.col("_x") == F.col("_v")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    edge = O.small(edge)                       # fewer than n_bins a key
    rows = df.select(*keys, *tie, F.col(y).alias("_y"), F.col(score).cast("double").alias("_x")).join(edge, cond)
    rows = rows.drop("_v", *[f"_k_{k}" for k in keys])
    r = O.hash_rank(rows, S.hash_int(*tie), tie, [*keys, "_x"], "_r")
    part = r.select(*keys, _bin_of(F.col("_lo") + F.col("_r"), F.col("_n"), n_bins).alias("bin"), exact("_x").cast("decimal(37,12)").alias("_s"),
                    F.col("_y").cast("long").alias("_p"), F.lit(1).cast("long").alias("n"))
    return whole.unionByName(part).groupBy(*keys, "bin").agg(
        F.sum("_s").alias("score_sum"), F.sum("_p").alias("attacks"), F.sum("n").alias("n"))


def reliability_bins(df: DataFrame, keys: list[str], tie: list[str], n_bins: int = 15,
                     score: str = "score", y: str = "y", table: DataFrame | None = None) -> DataFrame:
    """A20. Mean score, attack frequency and size per equal-mass bin."""
    g = bin_sums(df, keys, tie, n_bins, score, y, table)
    return g.select(*keys, "bin", (S.dbl("score_sum") / F.col("n")).alias("mean_score"),
                    (F.col("attacks") / F.col("n")).alias("attack_freq"), "n")


def ece(df: DataFrame, keys: list[str], tie: list[str], n_bins: int = 15, score: str = "score",
        y: str = "y") -> DataFrame:
    """A19. Expected calibration error over equal-mass bins of the clipped score."""
    b = bin_sums(df.withColumn("_c", S.clip(score, 0.0, 1.0)), keys, tie, n_bins, "_c", y)
    # n_b / n * |mean - frequency| without the two divisions by n_b
    gap = F.abs(F.col("score_sum") - F.col("attacks"))
    return b.groupBy(*keys).agg((S.dbl(F.sum(gap)) / F.sum("n")).alias("ece"))


def rebin_weighted(bins: DataFrame, keys: list[str], order: list[str], n_bins: int = 15) -> DataFrame:
    """A21. Pool the bins of all seeds and regroup them by cumulative share of n.

    The weighted sums are decimals of 9 places: they do not depend on the order of the bins.
    """
    part = lambda c: (F.col(c) * F.col("n")).cast("decimal(28,9)")         # noqa: E731
    w = Window.partitionBy(*keys)
    run = w.orderBy("mean_score", *order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(run) / F.sum("n").over(w)
    d = bins.withColumn("grp_bin", F.least(F.floor(share * n_bins), F.lit(n_bins - 1)).cast("int"))
    return d.groupBy(*keys, "grp_bin").agg(
        (S.dbl(F.sum(part("mean_score"))) / F.sum("n")).alias("mean_score"),
        (S.dbl(F.sum(part("attack_freq"))) / F.sum("n")).alias("attack_freq"),
        F.sum("n").alias("n"))


def per_category_recall(df: DataFrame, keys: list[str], tau: float = 0.5,
                        benign: str = "benign") -> DataFrame:
    """A14. Recall per attack category; specificity for the benign category."""
    pred = predict("score", tau)
    hit = F.when(F.col("category") == benign, 1 - pred).otherwise(pred)
    return df.groupBy(*keys, "category").agg(F.avg(hit).alias("detection"),
                                             F.count(F.lit(1)).alias("n"))


def per_category_wide(rec: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """A14. One column per category."""
    return rec.groupBy(*keys).pivot("category", categories).agg(F.first("detection"))


def summarise_runs(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A54. Mean, sd, min, max and n of each metric."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"),
                 F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return runs.groupBy(*keys).agg(*aggs)


def range_band(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """A50. Range over models per threshold."""
    return df.groupBy(*by).agg(F.min(col).alias(f"{col}_min"), F.max(col).alias(f"{col}_max"))


def auc_flips(runs: DataFrame, keys: list[str], calibrator: str = "calibrator",
              auc: str = "roc_auc") -> DataFrame:
    """A55. Change of the AUC by each calibrator against the raw score; beyond 0.5 = inverted."""
    raw = runs.filter(F.col(calibrator) == "raw").select(*keys, F.col(auc).alias("raw_auc"))
    d = runs.filter(F.col(calibrator) != "raw").join(raw, keys)
    d = d.withColumn("auc_change", F.col(auc) - F.col("raw_auc"))
    return d.withColumn("inverted", (F.abs("auc_change") > 0.5).cast("int"))


def reference_equivalence(df: DataFrame, keys: list[str], a: str, b: str, tau: float = 0.5) -> DataFrame:
    """A56. Agreement of two scorers on the same rows."""
    d = df.withColumn("_d", F.abs(F.col(a) - F.col(b)))
    g = d.groupBy(*keys).agg(F.max("_d").alias("max_abs_diff"),
                             F.avg((predict(a, tau) == predict(b, tau)).cast("int")).alias("decision_agreement"))
    return g.join(O.exact_percentiles(d, "_d", {"p99_abs_diff": 0.99}, keys), keys)
