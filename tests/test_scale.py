"""What moves and what stays stored: rows are not shuffled where a small table decides about them."""
import hashlib
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.functions import ordered as O
from flowaudit.functions import scalars as S
from flowaudit.operators import audit as A
from flowaudit.operators import calibrate as K
from flowaudit.operators import counts as C
from flowaudit.operators import inference as I
from flowaudit.operators import models as M
from flowaudit.operators import perturb as R
from flowaudit.operators import shift as SH
from flowaudit.operators import splits as D
from flowaudit.plans import bindings as X
from flowaudit.plans import experiments as E


@contextmanager
def _no_guess(spark):
    """Spark does not broadcast by its own estimate, as on large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def _corpus(spark, n=400):
    d = spark.range(n).select(F.col("id").cast("string").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("c").alias("category"),
                              (F.col("id") % 20).cast("string").alias("grp"), (F.col("id") % 2 + 1).cast("int").alias("file"), F.lit(False).alias("is_copy"))
    return d.withColumn("a", S.hash_unit("row_id") + F.col("y")).withColumn("b", S.hash_unit(F.lit("b"), "row_id"))


@pytest.mark.parametrize("cut", [lambda d: D.random_split(d, [1, 2], "row_id"), lambda d: D.stratified_random_split(d, "row_id", 3),
                                 lambda d: D.apply_split(d, d.select(F.lit(1).alias("split_seed"), "grp", F.lit("test").alias("side")).distinct(), "grp")])
def test_splits_leave_the_rows_where_they_are(spark, cut):
    with _no_guess(spark):
        plan = _plan(cut(_corpus(spark)))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_first_n_with_null_keys_and_odd_limits(spark):
    d = spark.createDataFrame([(k, i) for k in ("a", None, "b") for i in range(50)], "k string, id int")
    h = S.hash_int(F.lit("s"), "k", "id")
    for limit, want in ((F.lit(0), 0), (F.lit(-1), 0), (F.lit(7), 7), (F.lit(50), 50), (F.lit(99), 50), (F.floor(F.col("_all") * 0.3), 15)):
        got = O.first_n_by_hash(d, h, ["id"], limit, ["k"]).groupBy("k").agg(F.count_if("picked").alias("n"), F.count("*").alias("all")).collect()
        assert {(r.k, r.n, r["all"]) for r in got} == {(k, want, 50) for k in ("a", None, "b")}
    first = O.first_n_by_hash(d, h, ["id"], F.lit(7), ["k"]).filter("picked AND k = 'a'").withColumn("_x", h)
    rest = O.first_n_by_hash(d, h, ["id"], F.lit(7), ["k"]).filter("NOT picked AND k = 'a'").withColumn("_x", h)
    assert first.agg(F.max("_x")).first()[0] < rest.agg(F.min("_x")).first()[0]


def test_first_n_cuts_inside_a_full_bucket(spark):
    d = spark.range(60).select("id", (F.col("id") % 3).alias("b"))
    got = O.first_n_by_hash(d, F.col("b") * (1 << 20), ["id"], F.lit(25)).filter("picked")
    assert sorted(r.id for r in got.collect()) == sorted([*range(0, 60, 3), *range(1, 15, 3)])


def test_bin_edges_do_not_shuffle_the_rows(spark):
    d = _corpus(spark).withColumn("score", F.round("a", 1))
    with _no_guess(spark):
        plan = _plan(C.bin_sums(d, ["grp"], ["row_id"], 3))
    assert "BroadcastHashJoin" in plan


def test_a_run_keeps_no_training_table(spark):
    corpus = _corpus(spark).persist()
    corpus.count()
    stored = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet().toArray())             # noqa: E731
    before = stored()
    for design in ("lofo", "random"):
        s = E.in_target_reference(spark, corpus, ["a", "b"], [M.BY_KEY["tree"]], design)
        assert s.count() > 0 and stored() == before
    corpus.unpersist()


def test_texts_of_the_corpus_are_made_behind_the_join(spark, data):
    lines = X.zeek_flows(spark, data)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(i for i, x in enumerate(lines) if "concat_ws" in x) < min(i for i, x in enumerate(lines) if "Join" in x)
    assert not any("concat_ws" in x for x in lines[min(i for i, x in enumerate(lines) if "Join" in x):])


def test_draws_are_dealt_to_all_tasks(spark):
    units = spark.createDataFrame([("a", i) for i in range(9)], "k string, unit int")
    d = I._all_draws(I._places(units, ["k"], "unit", "_place", "_n"), ["k"], 5, "s")
    assert d.rdd.getNumPartitions() == O.n_buckets(units) and d.count() == 45


def test_bootstrap_of_repeated_units_and_null_keys(spark):
    """A unit's rows are drawn together; null units take a place and are never met, null keys have no row."""
    rows = [("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 8.0), ("a", None, 5.0), ("b", 1, None), (None, 1, 2.0)]
    d = spark.createDataFrame(rows, "k string, unit int, v double")
    w = I.draw_weights(d.filter("v IS NOT NULL"), ["k"], "unit", 40, "s", "_w").collect()
    value = {1: (4.0, 2), 2: (8.0, 1)}
    want = {}
    for r in w:
        if r.k == "a" and r.unit is not None:
            s, n = want.get(r.rep, (0.0, 0))
            want[r.rep] = (s + r._w * value[r.unit][0], n + r._w * value[r.unit][1])
    got = I.bootstrap_mean(d, ["k"], "v", "unit", 40, "s").collect()
    means = sorted(s / n for s, n in want.values())
    assert [(r.k, r.n, r.n_boot) for r in got] == [("a", 4, len(means))]
    assert means[0] <= got[0].boot_lo <= got[0].boot_hi <= means[-1]


def test_scores_take_columns_of_a_split(spark, data):
    """What no detector decides is added below the three scores of a row, and changes none of them."""
    s = X.scores(spark, data, {"_h": S.hash_unit(F.col("split_seed").cast("string"), "row_id")})
    plain = X.scores(spark, data)
    assert s.columns == [*plain.columns[:-1], "_h", "score"] and s.drop("_h").exceptAll(plain).count() == 0 and s.count() == plain.count()
    lines = s._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Generate explode" in x for x in lines[:[i for i, x in enumerate(lines) if " AS _h#" in x][0]]) == 1


@pytest.mark.parametrize("kind", ["raw", "platt", "isotonic", "temperature"])
def test_calibrator_of_a_kept_table_is_the_same(spark, kind):
    d = _corpus(spark).select("row_id", "y", F.least(F.round(F.col("a") / 2, 2), F.lit(1.0)).alias("score"))
    a, b = (sorted(tuple(r) for r in use(d).select("row_id", F.round("calibrated", 9)).collect())
            for use in (K.fit_calibrator(d, kind), K.fit_calibrator(None, kind, table=C.score_table(d, []).persist())))
    assert a == b


def test_cells_of_a_cluster_are_filled_in_where_they_are(spark):
    """counts of a cluster answer all thresholds, and absent ones are added, without a join of the counts with a grid."""
    s = spark.range(300).select((F.col("id") % 2).cast("string").alias("model"), (F.col("id") % 7).cast("string").alias("grp"),
                                (F.col("id") % 3 == 0).cast("int").alias("y"), ((F.col("id") * 37 % 100) / 100.0).alias("score"))
    taus = [0.2, 0.5, 0.9, 1.5]
    with _no_guess(spark):
        d = C.densify(C.counts_at(s, taus, ["model", "grp"]), taus, ["model"], "grp")
        assert "Join" not in _plan(d)
        got = {(r.model, r.grp, r.tau): (r.tp, r.fp, r.fn, r.tn) for r in d.collect()}
    want = {}
    for r in s.collect():
        for t in taus:
            c = want.setdefault((r.model, r.grp, t), [0, 0, 0, 0])
            c[(0 if r.y else 1) if r.score >= t else (2 if r.y else 3)] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_densify_keeps_what_a_join_gave(spark):
    c = spark.createDataFrame([("m", "a", 0.5, 1, 2, 3, None), ("m", "a", 0.5, 9, 9, 9, 9), ("m", "b", 0.7, 1, 1, 1, 1), ("m", None, 0.5, 5, 5, 5, 5)],
                              "model string, grp string, tau double, tp long, fp long, fn long, tn long")
    got = sorted(((r.grp, r.tau, r.tp, r.fp, r.fn, r.tn) for r in C.densify(c, [0.5, 0.6], ["model"], "grp").collect()), key=str)
    zero = (0, 0, 0, 0)
    assert got == sorted([("a", 0.5, 1, 2, 3, 0), ("a", 0.5, 9, 9, 9, 9), ("a", 0.6, *zero), ("b", 0.5, *zero), ("b", 0.6, *zero),
                          (None, 0.5, *zero), (None, 0.6, *zero)], key=str)


def _counted(spark, d):
    """The table, and how many of its rows were read."""
    read = spark.sparkContext.accumulator(0)

    def seen(_):
        read.add(1)
        return True
    return d.filter(F.udf(seen, "boolean")(d.columns[0])), read


def test_runs_read_their_scores_once(spark):
    """the measures of a run come from one table of counted scores, and views are made of counts."""
    s = spark.range(400).select(F.lit("m").alias("model"), F.lit(1).alias("split_seed"), F.when(F.col("id") % 4 == 0, "target").otherwise("source").alias("domain"),
                                F.col("id").cast("string").alias("row_id"), F.when(F.col("id") % 50 != 7, (F.col("id") % 3 == 0).cast("int")).alias("y"),
                                ((F.col("id") % 3 != 0) & (F.col("id") % 8 == 0)).alias("is_copy"), F.lit("g").alias("grp"), F.lit("c").alias("category"),
                                F.when(F.col("id") % 90 != 5, (F.col("id") * 37 % 101) / 100.0).alias("score")).persist()
    k = ["model", "split_seed", "domain", "view"]
    v = C.views(s, ["target"])
    want = C.detection_metrics(C.confusion(v.withColumn("pred", C.predict()), k)).join(C.rank_metrics(v, k).drop("n_pos", "n_neg"), k).join(C.brier(v, k), k)
    once, read = _counted(spark, s)
    out = E.consolidate(once, ["target"])
    got = out["runs"]
    a, b = ([tuple(r) for r in d.orderBy(*k).collect()] for d in (got, want))
    assert got.columns == want.columns and len(a) == 4 and a == [pytest.approx(x) for x in b]
    assert read.value == 400
    bins = C.reliability_bins(v.filter("view in ('all', 'clean') and score is not null and y is not null"), k, ["row_id"])
    assert bins.count() == 45 and out["bins"].count() >= 45


def test_domain_areas_and_medians_read_each_table_once(spark):
    """One table of counted values gives the area and both medians of a feature."""
    a = spark.range(101).select((F.col("id") * F.col("id") % 53 / 7.0).alias("x"), F.when(F.col("id") % 5 > 0, F.col("id") % 4).cast("double").alias("z"), F.lit(None).cast("double").alias("w"))
    b = spark.range(60).select((F.col("id") * 11 % 37 / 3.0).alias("x"), (F.col("id") % 3 + 2).cast("double").alias("z"), F.lit(None).cast("double").alias("w"))
    cols = ["x", "z", "w"]
    u = SH.melt(a, cols).withColumn("d", F.lit(0)).unionByName(SH.melt(b, cols).withColumn("d", F.lit(1)))
    auc = {r.feature: max(r.roc_auc, 1 - r.roc_auc) for r in C.rank_metrics(u, ["feature"], "value", "d").collect()}
    med = {(r.feature, r.d): r.m for r in u.filter("value is not null").groupBy("feature", "d").agg(F.expr("percentile(value, 0.5)").alias("m")).collect()}
    (ra, na), (rb, nb) = _counted(spark, a), _counted(spark, b)
    got = {r.feature: (r.domain_auc, r.median_a, r.median_b) for r in SH.univariate_domain_auc(ra, rb, cols).collect()}
    assert set(got) == {"x", "z"} and all(got[f] == pytest.approx((auc[f], med[f, 0], med[f, 1])) for f in got)
    assert (na.value, nb.value) == (101, 60)


def test_cells_of_a_contingency_are_counted_once(spark):
    d = _corpus(spark)
    a = A.association(A.contingency(d, "grp", "y", ["file"]), ["file"])
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and plan.count("Range (") <= plan.count("InMemoryRelation")
    assert a.count() == 2


def test_percentiles_without_keys_shuffle_only_the_buckets_that_hold_them(spark):
    d = spark.range(20_000).select(S.hash_unit("id").alias("v"), (F.col("id") % 3).alias("f"))
    xs = sorted(r.v for r in d.collect())
    near = O._counts_near(d, "v", [0.01, 0.99])
    assert near.count() < 20_000 / 4
    e = O.exact_percentiles(d, "v", {"lo": 0.01, "hi": 0.99}).first()
    assert [e.lo, e.hi] == pytest.approx([np.percentile(xs, 1), np.percentile(xs, 99)], abs=1e-12)
    many = np.repeat(*zip(*[(r.v, r.f) for r in d.collect()]))
    assert O.exact_percentiles(d, "v", {"q": 0.37}, freq=F.col("f")).first().q == pytest.approx(np.percentile(many, 37), abs=1e-12)


@pytest.mark.parametrize("values, q, want", [([], 0.5, None), ([None, None], 0.5, None), ([2.0], 0.99, 2.0), ([1.0, 1.0, 1.0, 4.0, None], 0.5, 1.0),
                                             ([1.0, 2.0, 3.0, 4.0], 0.5, 2.5), ([0.0, 0.0, 5.0, float("nan")], 0.6, 4.0)])
def test_percentiles_of_few_values(spark, values, q, want):
    d = spark.createDataFrame([(v,) for v in values], "v double")
    assert O.exact_percentiles(d, "v", {"q": q}).first().q == (want if want is None else pytest.approx(want))


def test_stale_rows_are_put_in_order_once(spark):
    d = _corpus(spark).withColumn("o", F.col("row_id").cast("long"))
    st = R.stale_telemetry(d, ["a"], 0.25, "s", "row_id", ["o"])
    plan = st._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(a#") == 1
    was = {r.o: r.a for r in d.collect()}
    got = st.collect()
    order = sorted((int(hashlib.md5(f"s|{r.row_id}".encode()).hexdigest()[:8], 16), r.row_id) for r in d.collect())
    hit = {i for _, i in order[:100]}
    assert st.columns == d.columns and len(got) == 400
    assert all(r.a == was[r.o - 1 if r.row_id in hit and r.o else r.o] for r in got)
