import hashlib
import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.functions import statdist as D
from flowaudit.operators import inference as I


def test_distribution_functions():
    assert D.t_ppf(0.975, 3) == pytest.approx(3.182446, abs=1e-5)
    assert D.t_ppf(0.975, 19) == pytest.approx(2.093024, abs=1e-5)
    assert D.t_two_sided(2.093024, 19) == pytest.approx(0.05, abs=1e-6)
    assert D.binom_ppf(0.025, 100, 0.5) == 40 and D.binom_ppf(0.975, 100, 0.5) == 60
    n, p = 30, 0.9
    cdf = list(itertools.accumulate(math.comb(n, k) * p ** k * (1 - p) ** (n - k) for k in range(n + 1)))
    assert D.binom_ppf(0.025, n, p) == next(k for k, c in enumerate(cdf) if c >= 0.025)


def test_t_quantile_column(spark):
    d = spark.createDataFrame([(1,), (2,), (20,), (201,), (5000,)], "n long").select("n", D.t_quantile(F.col("n")).alias("q"))
    q = {r.n: r.q for r in d.collect()}
    assert q[1] is None and q[20] == pytest.approx(2.093024, abs=1e-5)
    assert q[201] == pytest.approx(D.t_ppf(0.975, 200)) and q[5000] == pytest.approx(D.t_ppf(0.975, 4999), abs=1e-6)


def test_holm(spark):
    d = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, None), ("g", 5, 0.9)], "fam string, id int, p double")
    got = {r.id: r.p_holm for r in I.holm(d, ["fam"], "p").collect()}
    assert [got[i] for i in (1, 2, 3)] == pytest.approx([0.03, 0.06, 0.06]) and got[4] is None and got[5] == pytest.approx(0.9)


def test_corrected_interval(spark):
    x = [0.1, 0.15, 0.05, 0.2]
    r = I.paired_interval(spark.createDataFrame([(v,) for v in x], "d double").withColumn("k", F.lit(1)), ["k"], "d", 0.25).first()
    m, sd, t = statistics.mean(x), statistics.stdev(x), D.t_ppf(0.975, 3)
    assert r.nb_lo == pytest.approx(m - t * sd * math.sqrt(0.25 + 0.25)) and r.t_hi == pytest.approx(m + t * sd / 2)
    assert r.p_t == pytest.approx(D.t_two_sided(m / (sd / 2), 3)) and r.p_nb > r.p_t and r.d_z == pytest.approx(m / sd)


def test_degenerate_interval(spark):
    d = spark.createDataFrame([("one", 0.3), ("same", 0.2), ("same", 0.2)], "k string, d double")
    r = {x.k: x for x in I.paired_interval(d, ["k"], "d", 0.1).collect()}
    assert r["one"].nb_lo == 0.3 and r["one"].p_t is None and r["same"].nb_hi == 0.2 and r["same"].d_z is None


def test_kendall_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [("k%d" % (i % 2), rnd.randrange(6), rnd.randrange(40)) for i in range(120)]
    got = {r.k: r for r in I.kendall_tau(spark.createDataFrame(rows, "k string, x int, y int"), ["k"], "x", "y").collect()}
    for k in ("k0", "k1"):
        v = [(x, y) for kk, x, y in rows if kk == k]
        c = d = tx = ty = 0
        for (a, b), (p, q) in itertools.combinations(v, 2):
            s = (a - p) * (b - q)
            c, d, tx, ty = c + (s > 0), d + (s < 0), tx + (a == p), ty + (b == q)
        n0 = len(v) * (len(v) - 1) / 2
        assert (got[k].con, got[k].dis) == (c, d)
        assert got[k].kendall_tau == pytest.approx((c - d) / math.sqrt((n0 - tx) * (n0 - ty)))


def counts(spark, n_split=4, n_cl=6, flip=False):
    rnd = random.Random(9)
    rows = []
    for s in range(n_split):
        for c in range(n_cl):
            tp, fn = rnd.randrange(5, 20), rnd.randrange(1, 8)
            fp, tn = rnd.randrange(0, 6), rnd.randrange(10, 30)
            rows.append(("m", s, f"c{c}", 0.5, tp if not flip else fn, fp, fn if not flip else tp, tn))
    return spark.createDataFrame(rows, "model string, split_seed int, grp string, tau double, tp long, fp long, fn long, tn long")


def test_draws_are_multinomial(spark):
    c = counts(spark)
    w = I.draw_weights(c, ["model"], "grp", 50, "s", "_w")
    tot = [r.t for r in w.groupBy("rep").agg(F.sum("_w").alias("t")).collect()]
    assert tot == [6] * 50 and w.select("grp").distinct().count() == 6


def test_cluster_bootstrap_brackets_the_point(spark):
    c = counts(spark)
    r = I.cluster_bootstrap(c, ["model"], n_boot=100).first()
    t = c.agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")]).first()
    assert r.n_boot == 100 and r.tpr_lo <= t.tp / (t.tp + t.fn) <= r.tpr_hi and r.fpr_lo <= t.fp / (t.fp + t.tn) <= r.fpr_hi


def test_difference_bootstraps(spark):
    a, b = counts(spark), counts(spark, flip=True)
    d = I.delta_ba_bootstrap(a, b, ["model"], n_boot=80).first()
    assert d.point > 0.2 and d.boot_lo > 0 and d.boot_lo <= d.point <= d.boot_hi and d.p_boot < 0.1
    m = I.mean_ba_bootstrap(a, ["model"], n_boot=80).first()
    assert 0.5 < m.boot_lo <= m.point <= m.boot_hi < 1
    ref = a.groupBy("model", "grp").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn", "tn")])
    p = I.paired_reference_bootstrap(ref, b, ["model"], n_boot=60).first()
    assert p.point == pytest.approx(p.ref_ba - p.transfer_ba) and p.boot_lo > 0
    q = {r.measure: r for r in I.pooled_bootstrap(a, ["model"], n_boot=60).collect()}
    assert q["recall"].boot_lo <= q["recall"].point <= q["recall"].boot_hi and len(q) == 5


def test_identical_reference_has_no_gap(spark):
    a = counts(spark, n_split=1)
    ref = a.drop("split_seed", "tau")
    p = I.paired_reference_bootstrap(ref, a, ["model"], n_boot=30).first()
    assert p.point == 0 and p.boot_lo == 0 and p.boot_hi == 0


def test_spearman(spark):
    d = spark.createDataFrame([(1, 10), (2, 20), (3, 15), (3, 40)], "x int, y int").withColumn("k", F.lit(1))
    assert I.rank_correlation(d, ["k"], "x", "y").first().rho == pytest.approx(3.0 / math.sqrt(4.5 * 5.0))     # ranks 1, 2, 3.5, 3.5 and 1, 3, 2, 4


def test_units_of_one_key_are_numbered_without_gaps(spark):
    d = spark.range(500).select(F.when(F.col("id") < 400, "hot").otherwise("cold").alias("k"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("unit"))
    p = I._places(d, ["k"], "unit", "place", "n").collect()
    for k, n in (("hot", 400), ("cold", 100)):
        mine = sorted((first_bits(r.unit), r.place) for r in p if r.k == k)
        assert [x for _, x in mine] == list(range(1, n + 1)) and {r.n for r in p if r.k == k} == {n}


def first_bits(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("per_block", [1, 7, 1 << 13])
def test_bootstrap_over_values_equals_one_over_rows(spark, monkeypatch, per_block):
    """One value holds two thirds of the rows; the values may lie in one block or in many."""
    monkeypatch.setattr(I, "VALUES_PER_BLOCK", per_block)
    rnd = np.random.default_rng(3)
    v = np.concatenate([np.full(600, 4.0), rnd.integers(0, 40, 300).astype(float)])
    rows = [("a", float(x)) for x in v] + [("b", 5.0)] * 7 + [("c", None), ("d", float("nan")), (None, 1.0), (None, 3.0)]
    d = spark.createDataFrame(rows, "k string, v double")
    run = lambda: {r.k: r for r in I.bootstrap_mean_values(d.repartition(3), ["k"], "v", 4000).collect()}          # noqa: E731
    got = run()
    assert set(got) == {"a", "b", None}
    a = got["a"]
    means = rnd.choice(v, (4000, len(v))).mean(axis=1)
    assert (a.n, a.n_boot, a.few) == (900, 4000, 0) and a.mean == pytest.approx(v.mean())
    se = v.std() / math.sqrt(len(v))
    assert abs(a.boot_lo - np.quantile(means, 0.025)) < 0.2 * se and abs(a.boot_hi - np.quantile(means, 0.975)) < 0.2 * se
    b, none = got["b"], got[None]
    assert (b.n, b.mean, b.boot_lo, b.boot_hi, b.few) == (7, 5, 5, 5, 1)
    assert (none.n, none.mean, none.boot_lo, none.boot_hi) == (2, 2, 1, 3)
    assert run()["a"].boot_lo == pytest.approx(a.boot_lo, rel=1e-12)


def test_bootstrap_over_values_of_an_empty_table(spark):
    assert I.bootstrap_mean_values(spark.createDataFrame([], "k string, v double"), ["k"], "v", 50).count() == 0
