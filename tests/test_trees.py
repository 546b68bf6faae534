"""Trees from histograms against MLlib's and plain loops."""
import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowaudit.operators import counts as C
from flowaudit.operators import models as M
from flowaudit.operators import shift as SH
from flowaudit.operators import trees as H
from flowaudit.plans import experiments as E

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(2000):
        a, b, c, e = rng.random(), float(rng.integers(0, 5)), rng.random(), rng.random()
        rows.append((i, a, b, c, float(a + b / 5 + 0.7 * e > 1.2), 2.0 if i % 3 else 0.5))
    return spark.createDataFrame(rows, "row_id int, a double, b double, c double, label double, weight double").repartition(3).persist()


@pytest.mark.parametrize("make, params", [(DecisionTreeClassifier, {"maxDepth": 6}), (GBTClassifier, {"maxIter": 3, "maxDepth": 4, "stepSize": 0.1})])
def test_fits_without_draws_equal_mllib(table, make, params):
    est = make(labelCol="label", weightCol="weight", seed=3, **params)
    v = VectorAssembler(inputCols=COLS, outputCol="features").transform(table)
    want = {r.row_id: r.p for r in est.fit(v).transform(v).select("row_id", vector_to_array("probability")[1].alias("p")).collect()}
    h = H.fit(est, table, COLS)
    got = {r.row_id: r.p for r in table.select("row_id", h.probability(table, COLS).alias("p")).collect()}
    assert len(got) == 2000 and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_forest_draws_rows_and_columns(table):
    est = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=8, maxDepth=5, minInstancesPerNode=2, seed=3)
    h = H.fit(est, table, COLS)
    assert len(h.trees) == 8 and len({tuple(t.feature) for t in h.trees}) > 1
    s = table.select(F.lit(1).alias("k"), F.col("label").cast("int").alias("y"), h.probability(table, COLS).alias("score"))
    assert C.rank_metrics(s, ["k"]).first().roc_auc > 0.85


def test_a_level_in_several_passes_gives_the_same_tree(table, monkeypatch):
    est = DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=5, seed=3)
    one = H.fit(est, table, COLS).trees[0]
    monkeypatch.setattr(H, "HISTOGRAM_BYTES", 8 * 3 * 32 * 2 * 3)          # three nodes a pass
    monkeypatch.setattr(H, "DRIVER_BYTES", 0)                              # and all sums by shuffles
    many = H.fit(est, table, COLS).trees[0]
    paths = lambda t, i=0: (t.value[i],) if t.left[i] == i else (t.feature[i], t.cut[i], paths(t, t.left[i]), paths(t, t.right[i]))      # noqa: E731
    assert paths(one) == paths(many)


def test_fits_use_no_mllib_trees_and_store_bytes(table, monkeypatch):
    """The ladder's trees and the domain classifier hold a byte a value; MLlib's held objects of some hundred bytes a row."""
    def no(*_):
        raise AssertionError("an MLlib tree was fitted")
    for c in H.ESTIMATORS:
        monkeypatch.setattr(c, "_fit", no)
    d = table.withColumn("y", F.col("label").cast("int"))
    for spec in (E.with_params(M.BY_KEY["tree"], maxDepth=3), E.with_params(M.BY_KEY["xgboost"], maxIter=2, maxDepth=2)):
        assert M.predict_scores(M.fit_model(spec, d, COLS), d).filter("score between 0 and 1").count() == 2000
    r = SH.domain_classifier(d.filter("y = 0"), d.filter("y = 1"), COLS, "row_id", folds=2, max_iter=2).collect()
    assert len(r) == 2 and all(x.balanced_accuracy > 0.7 for x in r)
    b = H._blocks(table.select(*COLS, F.col("label").cast("int"), "weight", F.lit(-1).alias("k")), [np.linspace(0.1, 0.9, 9)] * 3)
    assert b.agg(F.sum(F.length("x")), F.sum("n")).first() == (6000, 2000)


def test_null_features_and_labels_are_refused(table):
    est = DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=2, seed=3)
    for c in ("a", "label"):
        with pytest.raises(Exception, match="NULL"):
            H.fit(est, table.withColumn(c, F.when(F.col("row_id") > 5, F.col(c))), COLS)


def test_cut_points():
    assert H.cut_points(np.array([1.0, 3.0, 3.0]), np.ones(3)).tolist() == [2.0]
    x = np.arange(1000.0)
    c = H.cut_points(x, np.ones(1000))
    n = np.bincount(np.searchsorted(c, x))
    assert len(c) == 31 and n.max() - n.min() <= 2


def test_rounds_leave_no_copies(spark, table, monkeypatch):
    """One round's margins are stored at a time, and none after the fit."""
    monkeypatch.setattr(H, "DRIVER_BYTES", 0)
    held = lambda: len(spark.sparkContext._jsc.sc().getPersistentRDDs().keys().toList().mkString(",").split(","))      # noqa: E731
    before, during, grow = held(), [], H._grow
    monkeypatch.setattr(H, "_grow", lambda *a: during.append(held()) or grow(*a))
    H.fit(GBTClassifier(labelCol="label", weightCol="weight", maxIter=5, maxDepth=2, seed=3), table, COLS)
    assert len(during) == 5 and max(during) <= before + 2 and held() <= before
