"""Intervals, tests and bootstraps over per-split tables and counts."""
from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S
from ..functions import statdist as D
from . import counts as C


# -------------------------------------------------------------- intervals
def nb_intervals(df: DataFrame, keys: list[str], metrics: list[str], ratio: float | Column = 0.0,
                 extra: list[Column] = ()) -> DataFrame:
    """I1, I2. Mean, plain t and corrected resampled-t interval of each metric, per key.

    se = sd * sqrt(1/J + ratio). One value or sd 0 collapses the interval to the mean and
    leaves the statistics NULL. NULL values do not count.
    """
    aggs = list(extra)
    for m in metrics:
        aggs += [F.count(m).alias(f"{m}_n"), F.avg(m).alias(f"{m}_mean"),
                 F.stddev_samp(m).alias(f"{m}_sd")]
    r = df.groupBy(*keys).agg(*aggs)
    q = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    for m in metrics:
        n, mean, sd = F.col(f"{m}_n"), F.col(f"{m}_mean"), F.col(f"{m}_sd")
        n = F.when(n > 0, n)
        live = (n >= 2) & (sd > 0)
        tq = D.t_quantile(n)
        se_t, se_nb = sd / F.sqrt(S.dbl(n)), sd * F.sqrt(1.0 / S.dbl(n) + q)
        for name, se in (("t", se_t), ("nb", se_nb)):
            r = (r.withColumn(f"{m}_{name}_lo", F.when(live, mean - tq * se).otherwise(mean))
                 .withColumn(f"{m}_{name}_hi", F.when(live, mean + tq * se).otherwise(mean))
                 .withColumn(f"{m}_t_{name}", F.when(live, F.try_divide(mean, se))))
    return r


def paired_interval(df: DataFrame, keys: list[str], diff: str | Column, ratio: float | Column = 0.0,
                    p_values: bool = True) -> DataFrame:
    """I1, I2 of one paired difference, with d_z and, if wanted, both p-values."""
    d = df.withColumn("d", S.as_col(diff))
    r = nb_intervals(d, keys, ["d"], ratio)
    r = (r.withColumnsRenamed({"d_n": "n", "d_mean": "mean", "d_t_lo": "t_lo", "d_t_hi": "t_hi",
                               "d_nb_lo": "nb_lo", "d_nb_hi": "nb_hi"})
         .withColumn("d_z", F.when(F.col("d_sd") > 0, S.ratio("mean", "d_sd"))))
    if p_values:
        dfree = S.dbl("n") - 1.0
        r = (r.withColumn("p_t", D.t_p_value(F.col("d_t_t"), dfree))
             .withColumn("p_nb", D.t_p_value(F.col("d_t_nb"), dfree)))
    return r.drop("d_sd", "d_t_t", "d_t_nb")


def group_ratio(runs: DataFrame, keys: list[str] = (), split: str = "split_seed",
                test: str = "n_test_groups", train: str = "n_train_groups") -> DataFrame:
    """I3. Ratio of totals of test to train groups over distinct splits."""
    d = runs.select(*keys, split, test, train).dropDuplicates([*keys, split])
    return d.groupBy(*keys).agg(S.ratio(F.sum(test), F.sum(train)).alias("ratio_groups"))


def row_ratio(runs: DataFrame, keys: list[str] = (), split: str = "split_seed") -> DataFrame:
    """I3. Mean of n_eval / n_train over distinct splits."""
    d = runs.select(*keys, split, "n_eval", "n_train").dropDuplicates([*keys, split])
    return d.groupBy(*keys).agg(F.avg(S.ratio("n_eval", "n_train")).alias("ratio_rows"))


def holm(df: DataFrame, family: list[str], p: str, out: str | None = None) -> DataFrame:
    """W16. Holm step-down p-values within a family; NULL and NaN pass through."""
    out = out or f"{p}_holm"
    pv = F.when(~F.isnan(F.col(p)), F.col(p))
    d = df.withColumn("_p", pv)
    live = F.col("_p").isNotNull().cast("int")
    d = d.withColumn("_live", live)
    w = Window.partitionBy(*family, "_live")
    m = F.count(F.lit(1)).over(w)
    step = (m - F.row_number().over(w.orderBy("_p")) + 1) * F.col("_p")
    d = d.withColumn("_s", step)
    adj = F.max("_s").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, F.when(F.col("_live") == 1, F.least(F.lit(1.0), adj))
                        .otherwise(F.col(p))).drop("_p", "_live", "_s")


def paired_tests(df: DataFrame, keys: list[str], split: str, a: str, b: str) -> DataFrame:
    """I4. Paired t and Wilcoxon signed-rank on per-split means; skipped under 3 splits.

    Repeats inside a split (model seeds) are averaged first: they are nested. The signed
    rank p-value is the normal approximation with tie correction.
    """
    per = df.groupBy(*keys, split).agg(F.avg(a).alias("a"), F.avg(b).alias("b")) \
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("d", F.col("a") - F.col("b"))
    t = paired_interval(per, keys, "d").filter(F.col("n") >= 3)
    ab = F.abs("d")
    nz = per.filter(F.col("d") != 0).withColumn("_a", F.round(ab, 12))
    ties = nz.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("c"),
                                       F.count_if(F.col("d") > 0).alias("cp"))
    ties = O.running_sums(O.quantile_buckets(O.cached(ties), "_a"), ["_a"], {"_cum": F.col("c")}, keys).drop(O.BUCKET)
    ties = ties.withColumn("r", F.col("_cum") - (F.col("c") - 1) / 2.0)
    c, n = S.dbl("c"), F.col("nz")
    w = ties.groupBy(*keys).agg(F.sum(F.col("r") * F.col("cp")).alias("w_plus"),
                                F.sum("c").alias("nz"), F.sum(c * c * c - c).alias("_tie"))
    var = n * (n + 1.0) * (2.0 * n + 1.0) / 24.0 - F.col("_tie") / 48.0
    w = w.withColumn("wilcoxon_z", S.ratio(F.col("w_plus") - n * (n + 1.0) / 4.0, F.sqrt(var)))
    w = w.withColumn("wilcoxon_p", 2.0 * (1.0 - D.norm_cdf_col(F.abs("wilcoxon_z")))).drop("_tie", "nz")
    return t.join(w, keys, "left")


def min_detectable_effect(n: str | Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """I5. Smallest d_z a paired t-test detects."""
    z = D.norm_ppf(1 - alpha / 2) + D.norm_ppf(power)
    return F.lit(z) / F.sqrt(S.dbl(n))


# -------------------------------------------------------------- bootstrap
def draw_weights(units: DataFrame, keys: list[str], unit: str, n_boot: int, seed: str,
                       name: str, shared: bool = False) -> DataFrame:
    """Multinomial resampling weights: how often each unit is drawn in each replicate.

    Draw j of replicate b picks the unit at the 1-based place given by a hash of
    (seed, key, b, j). Only drawn units come out, so the table has at most
    n_boot * units rows and is built without a join of all pairs. With `shared`, the key
    is no part of the hash and every key draws the same places.
    """
    placed = _places(units.select(*keys, unit).distinct(), keys, unit, "_place", "_n")
    draws = _all_draws(placed, keys, n_boot, seed, shared)
    picked = draws.groupBy(*keys, "rep", "_place").agg(F.count(F.lit(1)).alias(name))
    return picked.join(placed.select(*keys, unit, "_place"), [*keys, "_place"]).drop("_place")


def _all_draws(placed: DataFrame, keys: list[str], n_boot: int, seed: str, shared: bool = False) -> DataFrame:
    """(keys, rep, _place): the place that each draw picks.

    The numbered units are few rows, which Spark would read in one task or two; they are dealt
    to all tasks before each becomes `n_boot` draws.
    """
    few = placed.select(*keys, "_place", "_n").repartition(O.n_buckets(placed))
    draws = few.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    parts = [F.lit(seed), F.col("rep"), F.col("_place")]
    if not shared:
        parts = [F.lit(seed), *[F.col(k) for k in keys], F.col("rep"), F.col("_place")]
    return draws.select(*keys, "rep", _draw(parts, "_n").alias("_place"))


def _places(d: DataFrame, keys: list[str], unit: str, place: str, n: str) -> DataFrame:
    """Number the units of a key from 1 in the order of their hash, and count them.

    Hash buckets are numbered side by side, so a key with most units is many tasks.
    """
    return O.hash_rank(d, S.hash_int(unit), [unit], keys, place, totals=True).withColumnRenamed(f"{place}_all", n)


def _draw(parts: list[Column], n: str) -> Column:
    return (F.floor(S.hash_unit(*parts) * F.col(n)) + 1).cast("long")


def percentile_ends(df: DataFrame, keys: list[str], cols: list[str], alpha: float = 0.05) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.percentile(c, F.lit(alpha / 2)).alias(f"{c}_lo"),
                 F.percentile(c, F.lit(1 - alpha / 2)).alias(f"{c}_hi")]
    return df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_boot"))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, unit: str, n_boot: int = 10_000,
                   seed: str = "boot") -> DataFrame:
    """I7. Percentile bootstrap of a mean; `few` marks fewer than 30 values.

    Rows of one unit are drawn together. A draw meets the sum and number of its unit's values,
    by broadcast while the units are few, and is summed where it is.
    """
    d = df.filter(F.col(value).isNotNull())
    placed = _places(d.select(*keys, unit).distinct(), keys, unit, "_place", "_n")
    own = d.groupBy(*keys, unit).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_m"))
    placed = O.cached(placed)
    found = O.small(placed.join(own, [*keys, unit]).select(*keys, "_place", "_v", "_m"))
    reps = _all_draws(placed, keys, n_boot, seed).join(found, [*keys, "_place"]).groupBy(*keys, "rep").agg(
        (F.sum("_v") / F.sum("_m")).alias("boot"))
    pt = d.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    out = pt.join(percentile_ends(reps, keys, ["boot"]), keys)
    return out.withColumn("few", (F.col("n") < 30).cast("int"))


VALUES_PER_BLOCK, MAX_BLOCKS = 1 << 13, 1 << 12


def _generator(*parts) -> np.random.Generator:
    """The same numbers for the same parts, so a task run again draws what it drew before."""
    return np.random.default_rng(list(hashlib.sha256("|".join(map(str, parts)).encode()).digest()))


def bootstrap_mean_values(df: DataFrame, keys: list[str], value: str, n_boot: int = 10_000,
                          seed: str = "boot") -> DataFrame:
    """I7. Percentile bootstrap of a mean over all rows, drawn over distinct values.

    A replicate draws n rows of n. How often it draws each distinct value is multinomial in the
    values' counts, so the work is distinct values * replicates and rows are only counted. Values are
    dealt by a hash into blocks of about `VALUES_PER_BLOCK` (at most `MAX_BLOCKS` a key): the n draws
    are first dealt to the blocks of a key, then each block deals its own to its values, one
    replicate at a time. Blocks return one sum for each replicate.

    NULL and NaN values do not count; a key without others has no row. NULL keys are a group.
    """
    keys = list(keys)
    v = df.select(*keys, S.dbl(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    v = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    size = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_d"), F.sum(F.col("_v") * F.col("_c")).alias("_s"),
                                F.sum("_c").alias("n"))
    blocks = F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("_d") / VALUES_PER_BLOCK)).cast("int")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    sized = size.select(*[F.col(k).alias(f"_k_{k}") for k in keys], blocks.alias("_blocks"))
    v = v.join(sized, on).select(*keys, F.pmod(F.xxhash64("_v"), F.col("_blocks")).cast("int").alias("_b"), "_v", "_c")
    per = v.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in per.select(*keys).schema.fields)

    def deal(key, t):
        t = t.sort_values("_b")
        p = t["_c"].to_numpy(np.float64)
        got = _generator(seed, "blocks", *key).multinomial(int(t["_c"].sum()), p / p.sum(), size=n_boot)
        return t[[*keys, "_b"]].assign(_k=list(got.T))

    def sums(key, t, drawn):
        t = t.sort_values("_v")
        x, p = t["_v"].to_numpy(np.float64), t["_c"].to_numpy(np.float64)
        rng, p = _generator(seed, "values", *key), p / p.sum()
        s = [rng.multinomial(int(k), p) @ x for k in drawn["_k"].iloc[0]]
        return t[keys].head(1).assign(_x=[np.array(s)])

    drawn = per.groupBy(*keys).applyInPandas(deal, f"{types}_b int, _k array<bigint>")
    parts = v.groupBy(*keys, "_b").cogroup(drawn.groupBy(*keys, "_b")).applyInPandas(sums, f"{types}_x array<double>")
    reps = parts.select(*keys, F.posexplode("_x").alias("rep", "_x")).groupBy(*keys, "rep").agg(F.sum("_x").alias("boot"))
    ends = percentile_ends(reps, keys, ["boot"]).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    n = F.col("n")
    return size.join(ends, on).select(*keys, (F.col("_s") / n).alias("mean"), "n", (F.col("boot_lo") / n).alias("boot_lo"),
                                      (F.col("boot_hi") / n).alias("boot_hi"), "n_boot", (n < 30).cast("int").alias("few"))


def _weighted_cells(counts: DataFrame, weights: list[tuple[DataFrame, list[str]]],
                    keys: list[str]) -> DataFrame:
    """Counts joined to resampling weights and summed per (keys, rep)."""
    d, w = counts, []
    have_rep = False
    for i, (t, on) in enumerate(weights):
        d = d.join(t.withColumnRenamed([c for c in t.columns if c.startswith("_w")][0], f"_w{i}"),
                   on + (["rep"] if have_rep else []))
        have_rep = True
        w.append(F.col(f"_w{i}"))
    wt = reduce(lambda a, b: a * b, w)
    return d.groupBy(*keys, "rep").agg(*[F.sum(wt * F.col(c)).alias(c) for c in C.CELLS])


def cluster_bootstrap_reps(counts: DataFrame, model_keys: list[str], cluster: str = "grp",
                           split: str = "split_seed", n_boot: int = 2000, seed: str = "7") -> DataFrame:
    """I8. Replicates: clusters and split seeds resampled independently, counts re-pooled.

    Counts are first summed to (model, split, cluster, tau), so the join with the drawn
    weights grows with that table and not with scored rows.
    """
    base = counts.groupBy(*model_keys, split, cluster, "tau").agg(*[F.sum(c).alias(c) for c in C.CELLS])
    wc = draw_weights(base, model_keys, cluster, n_boot, f"{seed}c", "_wc")
    ws = draw_weights(base, model_keys, split, n_boot, f"{seed}s", "_ws")
    return _weighted_cells(base, [(wc, [*model_keys, cluster]), (ws, [*model_keys, split])],
                           [*model_keys, "tau"])


def cluster_bootstrap(counts: DataFrame, model_keys: list[str], cluster: str = "grp",
                      split: str = "split_seed", n_boot: int = 2000, seed: str = "7",
                      tau: float = 0.5) -> DataFrame:
    """I8. Percentile intervals of tpr, fpr, PPV at tau and of the best PPV over all tau."""
    reps = cluster_bootstrap_reps(counts, model_keys, cluster, split, n_boot, seed)
    tpr = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    fpr = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    r = reps.withColumn("tpr", tpr).withColumn("fpr", fpr).withColumn("ppv", S.ppv("tpr", "fpr"))
    at = S.same_tau("tau", tau)
    s = r.groupBy(*model_keys, "rep").agg(
        F.max(F.when(at, F.col("tpr"))).alias("tpr"), F.max(F.when(at, F.col("fpr"))).alias("fpr"),
        F.max(F.when(at, F.col("ppv"))).alias("ppv"),
        F.max(F.when(F.col("tpr") >= S.MIN_RECALL, F.col("ppv"))).alias("best_ppv"))
    return percentile_ends(s, model_keys, ["tpr", "fpr", "ppv", "best_ppv"])


def boot_summary(reps: DataFrame, keys: list[str], x: str, point: DataFrame) -> DataFrame:
    """I9. Bias-corrected percentile interval and the level at which it reaches zero.

    `point` has (keys…, point). Percentiles at data-dependent levels interpolate the two
    neighbouring order statistics of the replicates of a key.
    """
    d = reps.filter(F.col(x).isNotNull()).join(point, keys)
    a = d.groupBy(*keys, "point").agg(
        F.count(F.lit(1)).alias("n_boot"), F.avg(x).alias("_m"),
        ((F.count_if(F.col(x) < F.col("point")) + 0.5 * F.count_if(F.col(x) == F.col("point")))
         / F.count(F.lit(1))).alias("_p0"),
        ((F.count_if(F.col(x) < 0) + 0.5 * F.count_if(F.col(x) == 0)) / F.count(F.lit(1))).alias("_q0"),
        F.array_sort(F.collect_list(x)).alias("_xs"))          # n_boot values per key, a parameter
    lim = 1.0 / (F.col("n_boot") + 1.0)

    def z(c):
        return D.norm_ppf_col(F.least(F.greatest(F.col(c), lim), 1.0 - lim))

    a = a.withColumn("_z0", z("_p0")).withColumn("_zx", z("_q0") - 2.0 * F.col("_z0"))
    for end, p in (("lo", 0.025), ("hi", 0.975)):
        h = D.norm_cdf_col(2.0 * F.col("_z0") + D.norm_ppf(p)) * (F.col("n_boot") - 1)
        a = a.withColumn("_h", h)
        i = F.floor("_h").cast("int")
        lo = F.element_at("_xs", i + 1)
        hi = F.element_at("_xs", F.least(i + 2, F.col("n_boot").cast("int")))
        a = a.withColumn(f"boot_{end}", lo + (F.col("_h") - i) * (hi - lo))
    c = D.norm_cdf_col(F.col("_zx"))
    a = a.withColumn("_c", c)
    a = a.withColumn("p_boot", F.least(F.lit(1.0), 2.0 * F.least(F.col("_c"), 1.0 - F.col("_c"))))
    return a.withColumn("bias", F.col("_m") - F.col("point")).drop("_m", "_p0", "_q0", "_xs", "_z0",
                                                                     "_zx", "_h", "_c")


def _ba_by_split(counts: DataFrame, keys: list[str], split: str) -> DataFrame:
    return counts.groupBy(*keys, split).agg(*[F.sum(c).alias(c) for c in C.CELLS]) \
        .withColumn("ba", S.balanced_accuracy())


def _nested_reps(tgt: DataFrame, keys: list[str], cluster: str, split: str, n_boot: int,
                 seed: str, joint_clusters: bool = False) -> DataFrame:
    """BA per (keys, rep, split draw): splits drawn, clusters drawn within each drawn split.

    A split drawn k times resamples its clusters k times, once per draw.
    """
    placed = _places(tgt.select(*keys, split).distinct(), keys, split, "_place", "_n")
    draws = placed.repartition(O.n_buckets(placed)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    draws = draws.select(*keys, "rep", F.col("_place").alias("draw"),
                         _draw([F.lit(f"{seed}s"), *[F.col(k) for k in keys], "rep", "_place"], "_n").alias("_place"))
    picked = draws.join(placed.select(*keys, split, "_place"), [*keys, "_place"]).drop("_place")
    cl = _places(tgt.groupBy(*keys, split, cluster).agg(*[F.sum(c).alias(c) for c in C.CELLS]),
                 [*keys, split], cluster, "_cp", "_cn")
    d = picked.join(cl.select(*keys, split, "_cp", "_cn"), [*keys, split])
    parts = [F.lit(f"{seed}c"), *[F.col(k) for k in keys], F.col("rep"), F.col("_cp")]
    if not joint_clusters:
        parts.append(F.col("draw"))
    d = d.withColumn("_cp", _draw(parts, "_cn"))
    d = d.groupBy(*keys, split, "rep", "draw", "_cp").agg(F.count(F.lit(1)).alias("_w"))
    d = d.join(cl.drop("_cn"), [*keys, split, "_cp"])
    return d.groupBy(*keys, "rep", "draw", split).agg(
        *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in C.CELLS]).withColumn("ba", S.balanced_accuracy())


def delta_ba_bootstrap(src: DataFrame, tgt: DataFrame, keys: list[str], cluster: str = "grp",
                       split: str = "split_seed", n_boot: int = 2000, seed: str = "20261107") -> DataFrame:
    """I10. Mean over splits of source BA minus target BA; target clusters resampled within split."""
    s = _ba_by_split(src, keys, split).select(*keys, split, F.col("ba").alias("src_ba"))
    pt = _ba_by_split(tgt, keys, split).join(s, [*keys, split]).groupBy(*keys).agg(
        F.avg(F.col("src_ba") - F.col("ba")).alias("point"))
    live = tgt.join(s.select(*keys, split), [*keys, split], "left_semi")
    reps = _nested_reps(live, keys, cluster, split, n_boot, seed).join(s, [*keys, split])
    r = reps.groupBy(*keys, "rep").agg(F.avg(F.col("src_ba") - F.col("ba")).alias("x"))
    return boot_summary(r, keys, "x", pt)


def mean_ba_bootstrap(counts: DataFrame, keys: list[str], cluster: str = "grp",
                      split: str = "split_seed", n_boot: int = 2000, seed: str = "20261107") -> DataFrame:
    """I11. Mean BA over splits with its interval and the p-value against 0.5."""
    pt = _ba_by_split(counts, keys, split).groupBy(*keys).agg((F.avg("ba") - 0.5).alias("point"))
    reps = _nested_reps(counts, keys, cluster, split, n_boot, seed)
    r = reps.groupBy(*keys, "rep").agg((F.avg("ba") - 0.5).alias("x"))
    out = boot_summary(r, keys, "x", pt).withColumnRenamed("p_boot", "p_vs_chance")
    for c in ("point", "boot_lo", "boot_hi"):
        out = out.withColumn(c, F.col(c) + 0.5)
    return out


def paired_reference_bootstrap(ref: DataFrame, tgt: DataFrame, keys: list[str], cluster: str = "grp",
                               split: str = "split_seed", n_boot: int = 2000,
                               seed: str = "20261107") -> DataFrame:
    """I12. BA of a reference minus mean BA of the splits, clusters resampled jointly."""
    r0 = ref.withColumn(split, F.lit("ref"))
    t0 = tgt.withColumn(split, F.col(split).cast("string"))
    refb = _ba_by_split(r0, keys, split).select(*keys, F.col("ba").alias("ref_ba"))
    pt = _ba_by_split(t0, keys, split).groupBy(*keys).agg(F.avg("ba").alias("transfer_ba")) \
        .join(refb, keys).withColumn("point", F.col("ref_ba") - F.col("transfer_ba"))
    # every side has the same clusters, so equal places mean equal clusters
    cl = ref.select(*keys, cluster).distinct()
    full = lambda d: _fill(d, cl, keys, cluster, split)          # noqa: E731
    a = _nested_reps(full(r0), keys, cluster, split, n_boot, seed, joint_clusters=True)
    b = _nested_reps(full(t0), keys, cluster, split, n_boot, seed, joint_clusters=True)
    a = a.groupBy(*keys, "rep").agg(F.avg("ba").alias("_r"))
    x = b.groupBy(*keys, "rep").agg(F.avg("ba").alias("_t")).join(a, [*keys, "rep"]) \
        .withColumn("x", F.col("_r") - F.col("_t"))
    return boot_summary(x, keys, "x", pt.select(*keys, "point")).join(
        pt.select(*keys, "ref_ba", "transfer_ba"), keys)


def _fill(counts: DataFrame, clusters: DataFrame, keys: list[str], cluster: str, split: str) -> DataFrame:
    per = counts.groupBy(*keys, split, cluster).agg(*[F.sum(c).alias(c) for c in C.CELLS])
    full = per.select(*keys, split).distinct().join(clusters, keys)
    return full.join(per, [*keys, split, cluster], "left").select(
        *keys, split, cluster, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in C.CELLS])


def pooled_bootstrap(counts: DataFrame, keys: list[str], cluster: str = "grp",
                     split: str = "split_seed", n_boot: int = 2000, seed: str = "20261107",
                     pi: float = S.PI) -> DataFrame:
    """I13. Pooled operating point over splits with bias-corrected intervals."""
    def measures(d: DataFrame) -> DataFrame:
        d = d.withColumn("recall", S.recall()).withColumn("fpr", S.fpr())
        d = d.withColumn("ppv", S.ppv("recall", "fpr", pi)).withColumn("corpus_precision", S.precision())
        return d.withColumn("alerts_per_h", S.LAMBDA_B * F.col("fpr"))
    reps = _nested_reps(counts, keys, cluster, split, n_boot, seed).groupBy(*keys, "rep").agg(
        *[F.sum(c).alias(c) for c in C.CELLS])
    names = ("recall", "fpr", "ppv", "alerts_per_h", "corpus_precision")
    stack = ", ".join(f"'{m}', {m}" for m in names)
    long = measures(reps).selectExpr(*keys, "rep", f"stack({len(names)}, {stack}) as (measure, x)")
    tot = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in C.CELLS])
    pt = measures(tot).selectExpr(*keys, f"stack({len(names)}, {stack}) as (measure, point)")
    return boot_summary(long, [*keys, "measure"], "x", pt).drop("p_boot")


# --------------------------------------------------------------- summaries
def paired(a: DataFrame, b: DataFrame, keys: list[str], suffixes=("_a", "_b")) -> DataFrame:
    """J1. Equi join of two run tables, other columns suffixed."""
    sa = a.select(*keys, *[F.col(c).alias(c + suffixes[0]) for c in a.columns if c not in keys])
    sb = b.select(*keys, *[F.col(c).alias(c + suffixes[1]) for c in b.columns if c not in keys])
    return sa.join(sb, keys)


def transfer_summary(runs: DataFrame, keys: list[str], ratio: float | Column, source: str,
                     target: str, floor: str = "majority", chance: str = "stratified",
                     metrics=("f1_macro", "balanced_accuracy", "roc_auc"),
                     p_values: bool = True) -> DataFrame:
    """I16, J19. Per model and measure: paired source - target difference, the difference in
    differences against the majority floor, the target against the stratified floor and
    against chance, with Holm correction per measure.
    """
    m0 = metrics[0]
    s = runs.filter(F.col("domain") == source).select(*keys, "model", "split_seed",
                                                      *[F.col(m).alias(f"s_{m}") for m in metrics])
    t = runs.filter(F.col("domain") == target).select(*keys, "model", "split_seed",
                                                      *[F.col(m).alias(f"t_{m}") for m in metrics])
    d = s.join(t, [*keys, "model", "split_seed"])
    base = d.groupBy(*keys, "split_seed").agg(
        F.max(F.when(F.col("model") == floor, F.col(f"s_{m0}") - F.col(f"t_{m0}"))).alias("_maj"),
        F.max(F.when(F.col("model") == chance, F.col(f"t_{m0}"))).alias("_str"))
    d = d.join(base, [*keys, "split_seed"])
    cols = {f"d_{m}": F.col(f"s_{m}") - F.col(f"t_{m}") for m in metrics}
    cols["did"] = F.col(f"s_{m0}") - F.col(f"t_{m0}") - F.col("_maj")
    cols["vs_floor"] = F.col(f"t_{m0}") - F.col("_str")
    if "balanced_accuracy" in metrics:
        cols["ba_vs_chance"] = F.col("t_balanced_accuracy") - 0.5
    long = d.select(*keys, "model", "split_seed", F.explode(F.create_map(
        *[x for k, v in cols.items() for x in (F.lit(k), v)])).alias("measure", "diff"))
    r = paired_interval(long, [*keys, "model", "measure"], "diff", ratio, p_values)
    if not p_values:
        return r
    trivial = F.col("model").isin(floor, chance)
    tested = holm(r.filter(~trivial), [*keys, "measure"], "p_nb")
    return tested.unionByName(r.filter(trivial).withColumn("p_nb_holm", F.lit(None).cast("double")))


def protocol_gain(runs: DataFrame, keys: list[str], metric: str, ratio: float | Column,
                  pairs=(("random", "group_disjoint"), ("random", "stratified_group"),
                         ("stratified_group", "group_disjoint")),
                  trivial=("majority", "stratified"), p_values: bool = True) -> DataFrame:
    """I17. Paired gain between split protocols per model and averaged over the models.

    Repeats inside a split are averaged first. The row `average` is the mean gain over the
    non-trivial models of each split.
    """
    names = sorted({p for ab in pairs for p in ab})
    per = runs.groupBy(*keys, "model", "split_seed").pivot("protocol", names).agg(F.avg(metric))
    long = per.select(*keys, "model", "split_seed", F.explode(F.array(*[
        F.struct(F.lit(f"{a}-{b}").alias("comparison"), (F.col(a) - F.col(b)).alias("gain"))
        for a, b in pairs])).alias("_g")).select(*keys, "model", "split_seed", "_g.*")
    avg = long.filter(~F.col("model").isin(*trivial)).groupBy(*keys, "split_seed", "comparison") \
        .agg(F.avg("gain").alias("gain")).withColumn("model", F.lit("average"))
    return paired_interval(long.unionByName(avg), [*keys, "comparison", "model"], "gain", ratio, p_values)


def harmonisation_loss(full: DataFrame, shared: DataFrame, metrics: list[str],
                       ratio: float | Column) -> DataFrame:
    """I18. Metric lost by moving from the full to the shared feature space."""
    j = paired(full.select("model", "split_seed", *metrics), shared.select("model", "split_seed", *metrics),
               ["model", "split_seed"], ("_full", "_shared"))
    long = j.select("model", "split_seed", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_full").alias("full"),
                 F.col(f"{m}_shared").alias("shared")) for m in metrics])).alias("_m")) \
        .select("model", "split_seed", "_m.*")
    iv = paired_interval(long, ["model", "metric"], F.col("full") - F.col("shared"), ratio, p_values=False)
    lv = long.groupBy("model", "metric").agg(F.avg("full").alias("full"), F.avg("shared").alias("shared"))
    return lv.join(iv, ["model", "metric"])


def exporter_contrast(a: DataFrame, z: DataFrame, keys: list[str], split: str = "split_seed") -> DataFrame:
    """I19. Paired BA difference of two exporters (z - a), t interval, signs of the interval."""
    j = paired(a, z, [*keys, split])
    r = paired_interval(j, keys, F.col("ba_b") - F.col("ba_a"), 0.0, p_values=False)
    lv = j.groupBy(*keys).agg(F.avg("ba_a").alias("ba_a"), F.avg("ba_b").alias("ba_b"))
    r = lv.join(r, keys)
    return (r.withColumn("sig_pos", (F.col("t_lo") > 0).cast("int"))
            .withColumn("sig_neg", (F.col("t_hi") < 0).cast("int")))


def reference_gap(ref_counts: DataFrame, tgt_counts: DataFrame, keys: list[str],
                  ratio: float | Column, split: str = "split_seed") -> DataFrame:
    """I20. Pooled leave-one-file reference BA minus the per-split transfer BA."""
    ref = ref_counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in C.CELLS]) \
        .select(*keys, S.balanced_accuracy().alias("ref_ba"))
    t = _ba_by_split(tgt_counts, keys, split).join(ref, keys)
    iv = paired_interval(t, keys, F.col("ref_ba") - F.col("ba"), ratio, p_values=False)
    lv = t.groupBy(*keys).agg(F.max("ref_ba").alias("ref_ba"), F.avg("ba").alias("transfer_ba"))
    return lv.join(iv, keys)


def add_reference_delta(df: DataFrame, ref: DataFrame, on: list[str], col: str, out: str) -> DataFrame:
    """J20. Absolute difference to a reference configuration; NULL where it is absent."""
    r = ref.select(*on, F.col(col).alias("_ref"))
    return df.join(r, on, "left").withColumn(out, F.abs(F.col(col) - F.col("_ref"))).drop("_ref")


def sample_size_curve(runs: DataFrame, n_ref: int, keys=("model", "view"), n: str = "n",
                      metric: str = "balanced_accuracy") -> DataFrame:
    """I21. Mean metric by source size and its change against the reference size."""
    g = runs.groupBy(n, *keys).agg(F.avg(metric).alias("mean"),
                                   F.count_distinct("split_seed").alias("splits"))
    return add_reference_delta(g, g.filter(F.col(n) == n_ref), list(keys), "mean", "abs_change")


def control_position(df: DataFrame, keys: list[str], value: str, temporal: str | Column) -> DataFrame:
    """I15. Where the temporal value lies among the control draws.

    `temporal` marks the temporal rows; several of them are averaged.
    """
    d = df.withColumn("_t", S.as_col(temporal))
    v = d.filter("_t").groupBy(*keys).agg(F.avg(value).alias("temporal"))
    c = d.filter(~F.col("_t")).join(v, keys)
    x = F.col(value)
    g = c.groupBy(*keys, "temporal").agg(
        F.count(F.lit(1)).alias("n_control"), F.avg(x).alias("control_mean"),
        F.stddev_samp(x).alias("control_sd"), F.min(x).alias("control_min"),
        F.max(x).alias("control_max"),
        F.avg((x < F.col("temporal")).cast("int")).alias("percentile_in_control"),
        F.count_if(x <= F.col("temporal")).alias("_le"))
    delta = F.col("temporal") - F.col("control_mean")
    return (g.withColumn("delta", delta)
            .withColumn("z", F.when(F.col("control_sd") > 0, S.ratio(delta, "control_sd")))
            .withColumn("outside_control_range", ((F.col("temporal") < F.col("control_min"))
                                                  | (F.col("temporal") > F.col("control_max"))).cast("int"))
            .withColumn("p_low", (1.0 + F.col("_le")) / (1.0 + F.col("n_control"))).drop("_le"))


def drift_summary(pos: DataFrame, keys: list[str]) -> DataFrame:
    """I22. Means over models of delta and z, and the number outside the control range."""
    return pos.groupBy(*keys).agg(F.avg("delta").alias("mean_delta"), F.avg("z").alias("mean_z"),
                                  F.sum("outside_control_range").alias("n_outside"),
                                  F.count(F.lit(1)).alias("n"))


def held_out_fpr(runs: DataFrame, unit: str) -> DataFrame:
    """I22. FPR of each held-out benign session over models."""
    g = runs.groupBy(unit).agg(F.avg("fpr").alias("fpr_mean"), F.min("fpr").alias("fpr_min"),
                               F.max("fpr").alias("fpr_max"))
    return g.withColumn("false_alerts_per_benign_ue_hour", F.col("fpr_mean") * float(S.WINDOWS_PER_UE_HOUR))


def in_target_summary(runs: DataFrame, keys=("feature_set", "protocol", "model")) -> DataFrame:
    """I24. BA mean, min and max by configuration."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("balanced_accuracy").alias("ba"),
                                   F.min("balanced_accuracy").alias("ba_min"),
                                   F.max("balanced_accuracy").alias("ba_max"), F.avg("fpr").alias("fpr"))


def kendall_tau(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """A34. Tau-b without forming pairs.

    For every pair the bit at which the dense ranks of y first differ is unique. Grouping by
    (bit, higher bits) and counting, along the order of x, how many earlier rows have the
    other bit value counts each concordant and discordant pair once.
    """
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    for c, n in (("_x", "rx"), ("_y", "ry")):
        d = d.join(O.value_ranks(d, c, keys).select(*keys, F.col("value").alias(c), F.col("dense").alias(n)), [*keys, c])
    d = O.cached(d.groupBy(*keys, "rx", "ry").agg(F.count(F.lit(1)).alias("c")))
    top = d.agg(F.max("ry")).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(max(0, int(top).bit_length() - 1)))
    e = d.withColumn("lv", F.explode(levels))
    bit = F.expr("cast(shiftright(ry, lv) & 1 as long)")
    e = e.withColumn("pref", F.expr("shiftright(ry, lv + 1)")).withColumn("bit", bit)
    g = e.groupBy(*keys, "lv", "pref", "rx").agg(F.sum(F.col("bit") * F.col("c")).alias("one"), F.sum((1 - F.col("bit")) * F.col("c")).alias("zero"))
    g = O.running_sums(g.withColumn(O.BUCKET, F.floor(F.col("rx") / 65536)), ["rx"], {"ones": F.col("one"), "zeros": F.col("zero")}, [*keys, "lv", "pref"])
    # rows of equal x are no pair: only what lies strictly below counts
    e = g.withColumn("con", F.col("one") * (F.col("zeros") - F.col("zero"))).withColumn("dis", F.col("zero") * (F.col("ones") - F.col("one")))
    s = e.groupBy(*keys).agg(F.sum("con").alias("con"), F.sum("dis").alias("dis"))

    def ties(col: str, name: str) -> DataFrame:
        t = d.groupBy(*keys, col).agg(F.sum("c").alias("t"))
        return t.groupBy(*keys).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(name),
                                    F.sum("t").alias(f"n_{name}"))
    s = s.join(ties("rx", "tx"), keys).join(ties("ry", "ty"), keys)
    n0 = S.dbl("n_tx") * (F.col("n_tx") - 1) / 2
    tau = F.try_divide(F.col("con") - F.col("dis"), F.sqrt(n0 - F.col("tx")) * F.sqrt(n0 - F.col("ty")))
    return s.select(*keys, F.col("n_tx").alias("n"), "con", "dis", tau.alias("kendall_tau"))


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """A33. Spearman rho with tie-averaged ranks."""
    d = df
    for c, n in ((x, "_rx"), (y, "_ry")):
        d = d.join(O.value_ranks(df, c, keys).select(*keys, F.col("value").alias(c), F.col("rank").alias(n)), [*keys, c])
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def correlations(df: DataFrame, keys: list[str], target: str, predictors: list[str]) -> DataFrame:
    """A32. Pearson r and r² of the target on each predictor; needs n >= 5 and a varying target."""
    long = df.select(*keys, target, F.explode(F.create_map(
        *[z for p in predictors for z in (F.lit(p), S.dbl(p))])).alias("predictor", "v"))
    g = long.groupBy(*keys, "predictor").agg(F.corr("v", target).alias("pearson_r"),
                                             F.count(F.lit(1)).alias("n"), F.stddev_samp(target).alias("_sd"))
    return g.filter((F.col("n") >= 5) & (F.col("_sd") > 0)) \
        .withColumn("r_squared", F.col("pearson_r") * F.col("pearson_r")).drop("_sd")
