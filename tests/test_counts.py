import math
import random

import pytest
from pyspark.sql import functions as F

from flowaudit.functions import ordered as O
from flowaudit.functions import scalars as S
from flowaudit.operators import burden as B
from flowaudit.operators import counts as C


def scored(spark, n=400, seed=1, hot=False):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = int(r.random() < 0.4)
        s = 1.0 if hot and r.random() < 0.5 else round(min(1.0, max(0.0, 0.3 * y + 0.7 * r.random())), 2)
        out.append(("a" if i % 3 else "b", i, y, s))
    return out, spark.createDataFrame(out, "k string, row_id int, y int, score double")


def brute_auc(pos, neg):
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(rows):
    """Step sum over distinct scores, highest first."""
    total, prev, out = sum(y for _, y in rows), 0.0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(y for v, y in rows if v >= s)
        n = sum(1 for v, _ in rows if v >= s)
        out += (tp / total - prev) * tp / n
        prev = tp / total
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_rank_metrics_against_brute_force(spark, hot):
    raw, df = scored(spark, hot=hot)
    got = {r.k: r for r in C.rank_metrics(df, ["k"]).collect()}
    for k in "ab":
        rows = [(s, y) for kk, _, y, s in raw if kk == k]
        pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
        assert got[k].roc_auc == pytest.approx(brute_auc(pos, neg), abs=1e-12)
        assert got[k].pr_auc == pytest.approx(brute_ap(rows), abs=1e-12)
        assert got[k].pr_auc_benign == pytest.approx(brute_ap([(1 - s, 1 - y) for s, y in rows]), abs=1e-12)


def test_single_class_has_no_rank_metric(spark):
    r = C.rank_metrics(spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.9)], "k string, y int, score double"), ["k"]).first()
    assert r.roc_auc is None and r.pr_auc is None


def test_threshold_is_inclusive_and_counts_add_up(spark):
    c = C.counts_at(spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 0, 0.2)], "k string, y int, score double"), C.TAU_FINE, ["k"])
    at = c.filter(S.same_tau("tau", 0.5)).first()
    assert (at.tp, at.fp, at.fn, at.tn) == (1, 1, 0, 1)
    rows = c.orderBy("tau").collect()
    assert len(rows) == len(C.TAU_FINE) and all(r.tp + r.fp + r.fn + r.tn == 3 for r in rows)
    assert all(a.tp >= b.tp and a.fp >= b.fp for a, b in zip(rows, rows[1:]))


def test_metrics_of_perfect_and_constant_predictions(spark):
    d = spark.createDataFrame([("p", 5, 0, 0, 5), ("c", 0, 0, 5, 5), ("o", 4, 0, 1, 0)], "k string, tp long, fp long, fn long, tn long")
    m = {r.k: r for r in C.detection_metrics(d).collect()}
    assert m["p"].mcc == pytest.approx(1) and m["p"].f1_macro == 1
    assert m["c"].precision == 0 and m["c"].mcc == 0 and m["c"].balanced_accuracy == 0.5
    assert m["o"].mcc == 0 and m["o"].balanced_accuracy == 0.8 and m["o"].fpr == 0


@pytest.mark.parametrize("hot", [False, True])
def test_equal_mass_bins_split_ties_by_hash(spark, hot):
    raw, df = scored(spark, 407, hot=hot)
    b = C.equal_mass_bins(df, 15, ["k"], ["row_id"])
    sizes = {}
    for r in b.groupBy("k", "bin").count().collect():
        sizes.setdefault(r.k, {})[r.bin] = r["count"]
    for k in "ab":
        n = sum(1 for x in raw if x[0] == k)
        want = [n // 15 + (i < n % 15) for i in range(15)]
        assert [sizes[k][i] for i in range(15)] == want
    hi = {(r.k, r.bin): (r.lo, r.hi) for r in b.groupBy("k", "bin").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()}
    assert all(hi[(k, i)][1] <= hi[(k, i + 1)][0] for k in "ab" for i in range(14))


def test_ece_of_few_rows(spark):
    d = spark.createDataFrame([(1, 0, 0.0), (2, 1, 1.0), (3, 1, 0.5)], "row_id int, y int, score double").withColumn("k", F.lit(1))
    assert C.ece(d, ["k"], ["row_id"]).first().ece == pytest.approx(0.5 / 3)


def test_hot_values_get_sub_buckets(spark):
    d = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0.7).otherwise(F.rand(1)).alias("v"))
    b = O.quantile_buckets(d, "v", 16, tie=S.hash_int("id"))
    big = b.groupBy(O.BUCKET).count().agg(F.max("count")).first()[0]
    assert big < 4000 / 8
    r = O.value_rank(d, "v", ["id"])
    got = [x.rank for x in r.orderBy("v", S.hash_int("id"), "id").collect()]
    assert got == list(range(1, 4001))


def test_views(spark):
    d = spark.createDataFrame([("t", 0, True), ("t", 1, False), ("s", 0, False)], "domain string, y int, is_copy boolean")
    got = sorted((r.domain, r.view, r.y) for r in C.views(d, ["t"]).collect())
    assert got == [("s", "all", 0), ("t", "all", 0), ("t", "all", 1), ("t", "clean", 1), ("t", "relab", 1), ("t", "relab", 1)]


def test_ppv_and_wilson(spark):
    d = spark.range(1).select(S.ppv(F.lit(1.0), F.lit(0.01)).alias("p"), S.wilson(F.lit(0), F.lit(100), False).alias("lo"), S.wilson(F.lit(0), F.lit(100), True).alias("hi"),
                              S.ppv(F.lit(0.0), F.lit(0.0)).alias("none")).first()
    assert d.p == pytest.approx(0.16694, abs=1e-5) and d.lo == 0 and d.hi == pytest.approx(0.0370, abs=1e-4) and d.none is None


def test_pooled_differs_from_mean_of_folds(spark):
    d = spark.createDataFrame([("m", 1, 10, 0, 0, 100), ("m", 2, 10, 10, 0, 90)], "model string, split_seed int, tp long, fp long, fn long, tn long")
    r = C.estimator_contrast(d, ["model"]).first()
    assert r.mean_of_folds > r.pooled and r.folds_fpr_zero == 1 and r.folds_ppv_one == 1


def test_three_valued_outcomes(spark):
    d = spark.range(1).select(S.tri(F.lit(0.0), F.lit(0.1), 0.1, True).alias("a"), S.tri(F.lit(0.2), F.lit(0.3), 0.1, True).alias("b"), S.tri(F.lit(0.0), F.lit(0.3), 0.1, True).alias("c"),
                              S.combine(F.lit("pass"), F.lit("inconclusive")).alias("d"), S.combine(F.lit("inconclusive"), F.lit("fail")).alias("e")).first()
    assert tuple(d) == ("pass", "fail", "inconclusive", "inconclusive", "fail")


def test_unreachable_model_keeps_its_row(spark):
    c = spark.createDataFrame([("m", 0.5, 0, 1, 10, 9)], "model string, tau double, tp long, fp long, fn long, tn long")
    r = B.ppv_reachability(C.pool_counts(c, ["model", "tau"]), ["model"]).first()
    assert r.ppv_max is None and r.tau_for_ppv_01 is None


def test_source_threshold_falls_back_to_the_smallest_tau(spark):
    c = spark.createDataFrame([("m", 0.1, 1, 9), ("m", 0.9, 0, 10), ("n", 0.1, 9, 1), ("n", 0.9, 5, 5)], "model string, tau double, tp long, fn long")
    assert {r.model: r.tau_star for r in B.source_thresholds(c, ["model"]).collect()} == {"m": 0.1, "n": 0.9}


def test_density_of_counts(spark):
    c = spark.createDataFrame([("m", "g", 0.5, 1, 0, 0, 0)], "model string, grp string, tau double, tp long, fp long, fn long, tn long")
    d = C.densify(c, [0.5, 0.6], ["model"], "grp").orderBy("tau").collect()
    assert [(r.tau, r.tp) for r in d] == [(0.5, 1), (0.6, 0)] and math.isclose(d[0].tau, 0.5)
