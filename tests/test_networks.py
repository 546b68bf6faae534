"""The network of the ladder against MLlib's."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from flowaudit.functions import scalars as S
from flowaudit.operators import models as M
from flowaudit.operators import networks as N
from flowaudit.plans import experiments as E

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1300):
        a, b, e = rng.normal(3, 2), rng.random(), rng.random()
        rows.append((i, float(a), float(b), 7.0, int(a / 4 + b + 0.3 * e > 1.4)))
    return spark.createDataFrame(rows, "row_id int, a double, b double, c double, y int").repartition(3, "row_id").sortWithinPartitions("row_id").persist()


@pytest.mark.parametrize("key, iters", [("published", 1), ("published", 30), ("ladder", 15)])
def test_fit_equals_mllib(table, key, iters):
    """Three partitions with a smaller last block each; the ladder's network repeats rows of the smaller class."""
    spec = E.with_params(M.PUBLISHED["mlp"] if key == "published" else M.BY_KEY["mlp"], maxIter=iters)
    d = table.withColumn("label", F.col("y").cast("double"))
    if key == "ladder":
        n1, n0 = M.class_counts(table)
        big, small, many = (n1, n0, 0) if n1 >= n0 else (n0, n1, 1)
        n = F.floor(F.when(F.col("y") == many, F.lit(big / small)).otherwise(1.0) + S.hash_unit(F.lit("os11"), "row_id")).cast("int")
        d = d.withColumn("_r", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))))
        assert d.count() > table.count()
    want = Pipeline(stages=[VectorAssembler(inputCols=COLS, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features"),
                            spec.build(3, 11)]).fit(d).stages[-1].weights.toArray()
    got = M.fit_model(spec, table, COLS).model.stages[-1].weights.toArray()
    assert np.abs(got - want).max() < 1e-4 * max(1.0, np.abs(want).max())


def test_fits_make_no_step_in_mllib(table, monkeypatch):
    """MLlib's network took minutes for what matrix products do in seconds; it gives the first weights only."""
    fit = MultilayerPerceptronClassifier._fit

    def still(self, df):
        assert self.getMaxIter() == 0, "a network was fitted by MLlib"
        return fit(self, df)
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", still)
    spec = E.with_params(M.BY_KEY["mlp"], maxIter=15)
    p = M.predict_scores(M.fit_model(spec, table, COLS), table)
    assert p.filter((F.col("score") > 0.5) == (F.col("y") == 1)).count() > 1100


def test_repeats_weigh_like_rows():
    rng = np.random.default_rng(1)
    sizes, x, y = [2, 4, 2], rng.normal(size=(50, 2)), rng.integers(0, 2, 50)
    w, times = rng.normal(size=2 * 4 + 4 + 4 * 2 + 2), rng.integers(1, 4, 50)
    once = N.loss_and_gradient(w, sizes, x, y, times.astype(float))
    assert np.allclose(once, N.loss_and_gradient(w, sizes, np.repeat(x, times, 0), np.repeat(y, times), np.ones(times.sum())))
    e = np.zeros(len(w))
    for i in range(len(w)):                                     # against differences
        e[i] = 1e-6
        up, down = (N.loss_and_gradient(w + s * e, sizes, x, y, np.ones(50))[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - N.loss_and_gradient(w, sizes, x, y, np.ones(50))[1 + i]) < 1e-4
        e[i] = 0.0
