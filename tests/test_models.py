import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.operators import calibrate as K
from flowaudit.operators import counts as C
from flowaudit.operators import latency as L
from flowaudit.operators import models as M
from flowaudit.operators import perturb as R
from flowaudit.operators import shift as SH
from flowaudit.plans import experiments as E


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    rows = []
    for i in range(400):
        y = int(r.random() < 0.9)
        rows.append((i, y, "benign" if y == 0 else "flood", f"g{i % 20}", r.gauss(2.0 * y, 1), r.gauss(0, 1)))
    return spark.createDataFrame(rows, "row_id int, y int, category string, grp string, a double, b double").persist()


def test_balanced_weights(table):
    w = M.balanced_weights(table)
    s = {r.y: (r.w, r.n) for r in w.groupBy("y").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()}
    assert s[0][0] == pytest.approx(200) and s[1][0] == pytest.approx(200)
    p = M.balanced_weights(table, policy="positive").filter("y = 1").first().weight
    assert p == pytest.approx(s[0][1] / s[1][1])


@pytest.mark.parametrize("key", ["majority", "stratified", "logreg", "tree", "mlp"])
def test_scores_are_probabilities(table, key):
    spec = M.BY_KEY[key] if key != "mlp" else E.with_params(M.BY_KEY[key], maxIter=5)
    s = M.predict_scores(M.fit_model(spec, table, ["a", "b"]), table)
    r = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("score").alias("n")).first()
    assert 0 <= r.lo <= r.hi <= 1 and r.n == 400
    if key == "logreg":
        assert C.rank_metrics(s.withColumn("k", F.lit(1)), ["k"]).first().roc_auc > 0.85


def test_weights_change_the_network(table):
    """Rows of large b count for nothing in one fit, so its scores differ from the plain one."""
    spec = E.with_params(M.BY_KEY["mlp"], maxIter=15)
    w = table.withColumn("w", (F.col("row_id") % 4 == 0).cast("double") * 4)
    a, b = ({r.row_id: r.score for r in M.predict_scores(M.fit_model(spec, w, ["a", "b"], extra_weight=e), w).collect()} for e in (None, "w"))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) > 0.01


def test_ladder_is_declared_in_full():
    assert [m.key for m in M.LADDER] == ["majority", "stratified", "logreg", "tree", "rf", "xgboost", "hgb", "mlp"]
    assert M.BY_KEY["rf"].build(2, 1).getNumTrees() == 200 and M.BY_KEY["xgboost"].build(2, 1).getMaxIter() == 300


def test_store_resumes(spark, table, tmp_path):
    path = str(tmp_path / "scores")
    u = lambda ks: [E.Unit({"split_seed": k}, table, {"t": table}) for k in ks]         # noqa: E731
    specs = [M.BY_KEY["majority"]]
    assert E.run_units(spark, u([1]), ["a"], specs, store=path).count() == 400
    assert E.run_units(spark, u([1, 2]), ["a"], specs, store=path).count() == 800


def test_isolation_forest_ranks_outliers(spark, table):
    benign = table.withColumn("a", F.col("row_id") % 7 + F.lit(0.0))
    forest = M.isolation_forest(benign, ["a", "b"], "row_id", n_trees=30)
    assert forest["tree"].nunique() == 30 and forest.groupby("tree")["size"].max().max() <= 256
    far = spark.createDataFrame([(1, 50.0, 50.0), (2, 3.0, 0.0)], "row_id int, a double, b double")
    s = {r.row_id: r.score for r in M.isolation_scores(far, ["a", "b"], forest).collect()}
    assert s[1] > 0.6 > s[2]


def test_reconstruction_error_of_the_subspace_is_zero(spark, table):
    d = table.withColumn("c", F.col("a") * 2 + F.col("b"))
    out, = M.reconstruction_scores(d, [d], ["a", "b", "c"], k=2)
    assert out.agg(F.max("score")).first()[0] < 1e-9


def test_calibrators(spark, table):
    s = table.withColumn("score", F.when(F.col("y") == 1, 0.6).otherwise(0.4) + F.col("b") * 0.01)
    for kind in ("raw", "platt", "isotonic", "temperature"):
        c = K.fit_calibrator(s, kind)(s)
        r = c.agg(F.min("calibrated").alias("lo"), F.max("calibrated").alias("hi")).first()
        assert 0 <= r.lo <= r.hi <= 1
    with pytest.raises(ValueError):
        K.fit_calibrator(s, "other")


def test_temperature_keeps_order_and_finds_one(spark):
    r = random.Random(3)
    p = [r.random() for _ in range(4000)]
    d = spark.createDataFrame([(v, int(r.random() < v)) for v in p], "score double, y int")
    T = K.best_temperature(K.temperature_nll(d, []), []).first().temperature
    assert 0.85 < T < 1.15


def test_prior_correction_and_estimates(spark):
    d = spark.createDataFrame([(1.0,), (0.0,), (0.5,)], "p double")
    got = [r.q for r in d.select(K.prior_correct("p", 0.5, 0.1).alias("q")).collect()]
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0, abs=1e-9) and got[2] == pytest.approx(0.1)
    rnd = random.Random(1)
    y = [int(rnd.random() < 0.2) for _ in range(4000)]
    s = [min(max(rnd.gauss(0.7 if v else 0.3, 0.15), 0.01), 0.99) for v in y]
    post = []
    for v in s:                       # exact posterior at a source prior of one half
        a, b = math.exp(-(v - 0.7) ** 2 / 0.045), math.exp(-(v - 0.3) ** 2 / 0.045)
        post.append(a / (a + b))
    pi, n = K.em_prior(spark.createDataFrame([(p,) for p in post], "score double"), 0.5)
    assert pi == pytest.approx(0.2, abs=0.03) and n < 200
    cal = spark.createDataFrame([(1, 1)] * 90 + [(1, 0)] * 10 + [(0, 1)] * 20 + [(0, 0)] * 80, "y int, pred int")
    tgt = spark.createDataFrame([(1,)] * 41 + [(0,)] * 59, "pred int")           # 0.3 · 0.9 + 0.7 · 0.2
    assert K.bbse_prior(cal, tgt).first().pi_hat == pytest.approx(0.3)


def test_quantile_order_interval(spark):
    x = [random.Random(i).random() for i in range(500)]
    d = spark.createDataFrame([(v,) for v in x], "v double").withColumn("k", F.lit(1))
    r = L.quantile_order_ci(d, "v", [0.5, 0.99], ["k"]).orderBy("q").collect()
    assert r[0].est == pytest.approx(np.percentile(x, 50)) and r[1].est == pytest.approx(np.percentile(x, 99))
    assert r[0].lo < r[0].est < r[0].hi and r[1].hi == max(x)


def test_run_header_and_name(spark):
    d = spark.createDataFrame([("# model=1 warmup=100 wall_s=5.2e1", "ric_hgb_p10.csv")], "line string, f string")
    m = d.select(L.parse_header("line")["meta"].alias("m"), *[c.alias(n) for c, n in zip(L.run_name(F.col("f")), ("model", "period"))]).first()
    assert m.m["warmup"] == 100 and m.m["wall_s"] == 52 and (m.model, m.period) == ("hgb", 10)


def test_wasserstein_and_domain_auc(spark):
    a = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (3.0, 2.0)], "x double, z double")
    b = spark.createDataFrame([(5.0, 1.0), (6.0, 2.0), (8.0, 1.0)], "x double, z double")
    w = {r.feature: r.w1 for r in SH.wasserstein1(SH.melt(a, ["x", "z"]), SH.melt(b, ["x", "z"])).collect()}
    assert w["x"] == pytest.approx(5.0) and w["z"] == pytest.approx(0.0)
    u = {r.feature: r.domain_auc for r in SH.univariate_domain_auc(a, b, ["x", "z"]).collect()}
    assert u["x"] == 1.0 and u["z"] == 0.5


def test_quantile_map_matches_interpolation(spark):
    rnd = random.Random(2)
    x = sorted(rnd.gauss(0, 1) for _ in range(300))
    d = spark.createDataFrame([(v,) for v in x], "x double")
    g = SH.quantile_map(d, ["x"], 101)
    got = sorted(r.x for r in SH.apply_quantile_map(d, g).collect())
    want = np.interp(x, np.percentile(x, np.linspace(0, 100, 101)), np.linspace(0, 1, 101))
    assert got == pytest.approx(want.tolist(), abs=1e-9)


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 2.0], [float(i % 7) for i in range(50)], [float(i * i) for i in range(1234)]])
def test_quantile_grid_is_exact(spark, values):
    d = spark.createDataFrame([(v, -v) for v in values] + [(None, float("nan"))], "x double, y double")
    for n in (2, 5, 1000):
        g = SH.quantile_map(d, ["x", "y"], n)
        for c, sign in (("x", 1), ("y", -1)):
            assert g[c] == pytest.approx(np.percentile([sign * v for v in values], np.linspace(0, 100, n)).tolist(), abs=1e-9)
    with pytest.raises(ValueError):
        SH.quantile_map(d.filter("x IS NULL"), ["x"])


def test_coral_gives_the_source_the_target_covariance(spark):
    rng = np.random.default_rng(0)
    s = rng.normal(size=(3000, 2)) @ np.array([[1, 0.9], [0, 0.3]])
    t = rng.normal(size=(3000, 2)) @ np.array([[1, -0.5], [0, 1.0]])
    ds, dt = (spark.createDataFrame(v.tolist(), "a double, b double") for v in (s, t))
    cs, ct = SH.coral(ds, dt, ["a", "b"])
    z = lambda x: (x - x.mean(0)) / x.std(0)                               # noqa: E731
    Cs, Ct = np.cov(z(s).T) + np.eye(2), np.cov(z(t).T) + np.eye(2)

    def power(c, p):
        w, v = np.linalg.eigh(c)
        return (v * w ** p) @ v.T
    want = z(s) @ power(Cs, -0.5) @ power(Ct, 0.5)
    got = np.array([tuple(r) for r in cs.collect()])
    assert np.allclose(np.cov(got.T), np.cov(want.T), atol=1e-6) and np.allclose(np.std(np.array([tuple(r) for r in ct.collect()]), axis=0), 1, atol=1e-6)


def test_importance_weights_read_the_whole_target(spark):
    s = spark.createDataFrame([(i, i / 10) for i in range(60)], "row_id long, x double")
    t = [(i, 1 + (i * i % 60) / 9) for i in range(60)]
    once, tenfold = (spark.createDataFrame([(60 * k + i, x) for k in range(n) for i, x in t], "row_id long, x double") for n in (1, 10))
    a, b = ({r.row_id: r.weight for r in SH.importance_weights(s, d, ["x"], "row_id", 1)[0].collect()} for d in (once, tenfold))
    assert all(abs(a[i] - b[i]) < 1e-3 for i in a)


def test_importance_weights_follow_the_shift(spark):
    r = random.Random(7)
    s = spark.createDataFrame([(i, r.gauss(0, 1)) for i in range(1500)], "row_id int, x double")
    t = spark.createDataFrame([(i, r.gauss(1, 1)) for i in range(1500)], "row_id int, x double")
    w, diag = SH.importance_weights(s, t, ["x"], "row_id", 1)
    m = w.agg(F.avg("weight").alias("m"), F.corr("weight", "x").alias("c"), (F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("mx")).first()
    assert m.m == pytest.approx(1) and m.c > 0.6 and 0.6 < m.mx < 1.2
    assert 0 < diag.first().iw_ess_frac < 1


def test_perturbations(spark, table):
    d = table.select("row_id", "y", "a", "b")
    sc = R.column_scale(d, ["a", "b"])
    assert R.attack(d, "gaussian_noise", 0.0, 1, "row_id") is d
    n = R.gaussian_noise(d, sc, 0.1, "s", "row_id").join(d.withColumnRenamed("a", "a0"), "row_id").select((F.col("a") - F.col("a0")).alias("e"))
    e = n.agg(F.avg("e").alias("m"), F.stddev("e").alias("s")).first()
    assert abs(e.m) < 0.05 * sc["a"] and e.s == pytest.approx(0.1 * sc["a"], rel=0.15)
    m = R.missing_telemetry(d, ["a", "b"], 0.01, "s").first()
    assert (m.a == 0) != (m.b == 0)
    st = R.stale_telemetry(d, ["a", "b"], 0.25, "s", "row_id", ["row_id"])
    prev = {r.row_id: r.a for r in d.collect()}
    changed = [r for r in st.collect() if r.a != prev[r.row_id]]
    assert 95 <= len(changed) <= 100 and all(r.a == prev[r.row_id - 1] for r in changed)
    ev = R.evasion(d, {"duration": 1.0}, 0.1, "s", "row_id", True) if "duration" in d.columns else None
    assert ev is None
    p = R.poison_labels(d, 0.1, "s", "row_id").join(d.withColumnRenamed("y", "y0"), "row_id").filter("y <> y0").count()
    assert p == 40
    with pytest.raises(ValueError):
        R.attack(d, "unknown", 0.1, 1, "row_id", ["a"])


def test_robustness_deltas(spark):
    d = spark.createDataFrame([("m", 0.0, 0.9, 0.8, 0.01), ("m", 0.5, 0.6, 0.5, 0.03)], "model string, eps double, f1_macro double, recall double, fpr double")
    r = R.robustness_deltas(d, ["model"]).filter("eps = 0.5").first()
    assert r.f1_drop == pytest.approx(0.3) and r.recall_drop == pytest.approx(0.3) and r.fpr_rise == pytest.approx(0.02)


def test_published_run_has_every_rung(spark, tmp_path):
    """Files are tested once in R2, stations both ways in R3, the vote only in R0; a second call fits nothing."""
    r = random.Random(8)
    rows = [(f"r{i}", int(i % 3 == 0), "c", "g", i % 6 + 1, 1 if i % 6 < 3 else 2, i % 3 != 0 and i % 10 == 0, float(i), r.gauss(2.0 * (i % 3 == 0), 1)) for i in range(240)]
    d = spark.createDataFrame(rows, "row_id string, y int, category string, grp string, file int, site int, is_copy boolean, pos double, a double").persist()
    sets, specs = {"published": ["pos", "a"], "clean": ["a"]}, [M.PUBLISHED["nb"], M.BY_KEY["majority"]]
    path = str(tmp_path / "s")
    s = E.published_run(spark, d, sets, specs, repeats=2, folds=3, store=path).persist()
    units = {(x.rung, x.feature_set, x.model): x for x in s.groupBy("rung", "feature_set", "model").agg(F.count_distinct("split").alias("k"), F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids")).collect()}
    assert {k[2] for k in units if k[0] == "R0"} == {"nb", "majority", "knn"} and {k[2] for k in units if k[0] != "R0"} == {"nb", "majority"}
    assert {(k[0], k[1]) for k in units} == {("R0", "published"), ("R1", "clean"), *((x, f) for x in ("R2", "R3") for f in sets)}
    assert all((v.k, v.n) == (2, 144) for k, v in units.items() if k[0] in ("R0", "R1"))
    assert all((v.k, v.n, v.ids) == ((3, 240, 240) if k[0] == "R2" else (2, 240, 240)) for k, v in units.items() if k[0] in ("R2", "R3"))
    a = {(x.rung, x.feature_set, x.model): x for x in E.published_summary(s).collect()}
    assert a["R2", "clean", "nb"].balanced_accuracy > 0.7 and a["R3", "clean", "majority"].recall == 0 and a["R2", "clean", "nb"].n_test == 240
    n = s.count()
    assert E.published_run(spark, d, sets, specs, repeats=2, folds=3, store=path).count() == n


def test_store_fits_what_a_lost_driver_left_out(spark, table, tmp_path):
    path = str(tmp_path / "scores")
    u = lambda: [E.Unit({"split_seed": 1}, table, {"t": table})]         # noqa: E731
    assert E.run_units(spark, u(), ["a"], [M.BY_KEY["majority"]], store=path).count() == 400
    assert E.run_units(spark, u(), ["a"], [M.BY_KEY["majority"], M.BY_KEY["stratified"]], store=path).count() == 800


def test_third_corpus_and_exporters(spark, table):
    d = table.withColumn("file", F.col("row_id") % 3).withColumn("row_id", F.col("row_id").cast("string"))
    sets = {"both": ["a", "b"], "one": ["b"]}
    s = E.third_corpus_run(spark, d, sets, [M.BY_KEY["logreg"]], [101, 102])
    n = {(r.feature_set, r.protocol): (r.n, r.k) for r in s.groupBy("feature_set", "protocol").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("k")).collect()}
    pos = d.filter("y = 1").count()
    held = round(0.3 * pos) + round(0.3 * (400 - pos))
    assert n == {(f, p): v for f in sets for p, v in (("random", (2 * held, 2)), ("leave_one_file", (400, 3)))}
    c = {r.feature_set: r for r in E.feature_set_ceilings(d.withColumn("b", F.lit(1.0)), sets).collect()}
    assert c["one"].n_distinct == 1 and c["one"].ba_ceiling == pytest.approx(0.5) and c["one"].share_in_conflicting == 1 and c["both"].ba_ceiling == 1
    far = d.withColumn("a", F.col("a") + 100)
    out = E.exporter_sensitivity(d, far, sets, max_iter=3, folds=2)
    dom = {r.feature_set: r.balanced_accuracy for r in out["domain"].collect()}
    assert dom["both"] == 1 and dom["one"] < 0.7
    f = {r.feature: r for r in out["features"].collect()}
    assert f["a"].domain_auc == 1 and f["b"].w1_source_quantile == 0 and (f["a"].robust, f["b"].robust) == (0, 1)
    m = out["summary"].first()
    assert m.w1_mean_robust == 0 and m.w1_mean_nonrobust == pytest.approx(f["a"].w1_source_quantile) and m.w1_mean_shared == pytest.approx(m.w1_mean_nonrobust / 2)


def test_folds_are_stratified(spark):
    d = spark.createDataFrame([(i, float(i % 10 < 3)) for i in range(103)], "row_id int, d double")
    n = {(r.d, r.fold): r["count"] for r in SH.stratified_folds(d, 5, "row_id", 7).groupBy("d", "fold").count().collect()}
    for c in (0.0, 1.0):
        sizes = [n[c, k] for k in range(5)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(1 for i in range(103) if float(i % 10 < 3) == c)
