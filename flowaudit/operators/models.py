"""The detector ladder on MLlib, and scoring."""
from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S
from . import networks as N
from . import trees as H

TRIVIAL = ["majority", "stratified"]
NOVELTY_QUANTILE = 0.99      # Fixed value: threshold quantile of the benign scores.


@dataclass(frozen=True)
class ModelSpec:
    key: str
    level: int                       # 1 trivial, 2 conventional, 3 neural
    build: Callable[[int, int], Estimator] | None
    scaled: bool = False
    balance: str = "weights"         # weights | positive | none
    tags: tuple[str, ...] = field(default_factory=tuple)


def _logreg(d: int, seed: int) -> Estimator:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=200, standardization=False)


def _tree(d: int, seed: int) -> Estimator:
    return DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=12, seed=seed)


def _forest(d: int, seed: int) -> Estimator:
    return RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=200, maxDepth=30,
                                  minInstancesPerNode=2, maxMemoryInMB=1024, seed=seed)


def _boosted(d: int, seed: int) -> Estimator:
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=300, maxDepth=6, stepSize=0.1,
                         subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)


def _boosted_full(d: int, seed: int) -> Estimator:
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=300, maxDepth=6, stepSize=0.1, seed=seed)


def _mlp(d: int, seed: int) -> Estimator:
    return MultilayerPerceptronClassifier(labelCol="label", layers=[d, 128, 64, 2], maxIter=300, seed=seed)


def _nb(d: int, seed: int) -> Estimator:
    return NaiveBayes(labelCol="label", modelType="gaussian")


LADDER = (
    ModelSpec("majority", 1, None, tags=("trivial",)),
    ModelSpec("stratified", 1, None, tags=("trivial",)),
    ModelSpec("logreg", 2, _logreg, True, tags=("conventional", "deployment")),
    ModelSpec("tree", 2, _tree, tags=("conventional",)),
    ModelSpec("rf", 2, _forest, tags=("conventional",)),
    ModelSpec("xgboost", 2, _boosted, balance="positive", tags=("conventional", "deployment")),
    ModelSpec("hgb", 2, _boosted_full, tags=("conventional",)),
    ModelSpec("mlp", 3, _mlp, True, balance="sample", tags=("deep",)),
)
BY_KEY = {m.key: m for m in LADDER}
# The published pipeline's estimators with their usual defaults
PUBLISHED = {
    "dt": ModelSpec("dt", 2, lambda d, s: DecisionTreeClassifier(labelCol="label", maxDepth=30, seed=s), True, "none"),
    "rf": ModelSpec("rf", 2, lambda d, s: RandomForestClassifier(labelCol="label", numTrees=100, maxDepth=30, maxMemoryInMB=1024, seed=s),
                    True, "none"),
    "nb": ModelSpec("nb", 2, _nb, True, "none"),
    "mlp": ModelSpec("mlp", 3, lambda d, s: MultilayerPerceptronClassifier(labelCol="label", layers=[d, 10, 20, 10, 2], seed=s), True, "none"),
}


def class_counts(df: DataFrame, y: str = "y") -> tuple[int, int]:
    r = df.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    return int(r[0]), int(r[1])


def balanced_weights(df: DataFrame, y: str = "y", policy: str = "weights", extra: str | None = None,
                     out: str = "weight", counts: tuple[int, int] | None = None) -> DataFrame:
    """M8. n/(2·n_c) per row; or n_neg/n_pos on positives for the boosted policy."""
    n1, n0 = counts or class_counts(df, y)
    if policy == "weights":
        w = F.when(F.col(y) == 1, (n1 + n0) / (2.0 * max(n1, 1))).otherwise((n1 + n0) / (2.0 * max(n0, 1)))
    elif policy == "positive":
        w = F.when(F.col(y) == 1, max(n0 / max(n1, 1), 1e-6)).otherwise(1.0)
    else:
        w = F.lit(1.0)
    return df.withColumn(out, w * F.col(extra) if extra else w)


class Constant:
    """M1, M2. A detector that does not read the features."""

    def __init__(self, key: str, prior: float, seed: int):
        self.key, self.prior, self.seed = key, prior, seed

    def score(self, df: DataFrame, row_id: str) -> Column:
        if self.key == "majority":
            return F.lit(1.0 if self.prior >= 0.5 else 0.0)
        return (S.hash_unit(F.lit(f"st{self.seed}"), row_id) < F.lit(self.prior)).cast("double")


class Fitted:
    """A fitted spec: scores are P(y = 1)."""

    def __init__(self, spec: ModelSpec, model, cols: list[str]):
        self.spec, self.model, self.cols = spec, model, cols


def fit_model(spec: ModelSpec, df: DataFrame, cols: list[str], seed: int = 11, row_id: str = "row_id",
              y: str = "y", extra_weight: str | None = None, counts: tuple[int, int] | None = None):
    """M1-M9, M17. Fit one spec with the class-imbalance policy of the ladder; `counts` of the classes, where known, save a pass."""
    n1, n0 = counts or class_counts(df, y)
    if spec.build is None:
        return Constant(spec.key, n1 / max(n1 + n0, 1), seed)
    if spec.balance == "sample":
        # no weight column in this estimator: the smaller class is repeated to equal mass, and a
        # row's own weight, relative to the mean, multiplies its repeats
        big, small, many = (n1, n0, 0) if n1 >= n0 else (n0, n1, 1)
        times = F.when(F.col(y) == many, F.lit(big / max(small, 1))).otherwise(1.0)
        if extra_weight:
            times = times * F.col(extra_weight) / float(df.agg(F.avg(extra_weight)).first()[0] or 1.0)
        rep = F.floor(times + S.hash_unit(F.lit(f"os{seed}"), row_id)).cast("int")
        d = df.withColumn("weight", S.dbl(rep if extra_weight else F.greatest(rep, F.lit(1)))).filter("weight > 0")
    else:
        d = balanced_weights(df, y, {"weights": "weights", "positive": "positive"}.get(spec.balance, "none"), extra_weight, counts=(n1, n0))
    d = d.withColumn("label", S.dbl(y))
    est = spec.build(len(cols), seed)
    if isinstance(est, H.ESTIMATORS):                                     # scales do not move a tree's splits
        return Fitted(spec, H.fit(est, d, cols), cols)
    if isinstance(est, MultilayerPerceptronClassifier):
        return Fitted(spec, _network(spec, est, d, cols), cols)
    stages = [VectorAssembler(inputCols=cols, outputCol="raw" if spec.scaled else "features")]
    if spec.scaled:
        stages.append(StandardScaler(withMean=True, inputCol="raw", outputCol="features"))
    if isinstance(est, LogisticRegression):
        total = d.agg(F.sum("weight")).first()[0]
        est = est.setRegParam(1.0 / total)
    model = Pipeline(stages=[*stages, est]).fit(d.select("label", "weight", *cols))
    return Fitted(spec, model, cols)


def _network(spec: ModelSpec, est: MultilayerPerceptronClassifier, df: DataFrame, cols: list[str]) -> PipelineModel:
    """A network behind MLlib's scaler. A row's weight is the number of its repeats, in the scaler's moments too; without repeats it is not read."""
    d, w = len(cols), S.dbl("weight") if spec.balance == "sample" else F.lit(1.0)
    rows = df.select(*[S.dbl(c).alias(f"_x{i}") for i, c in enumerate(cols)], F.col("label").cast("int").alias("_y"), w.alias("_w"))
    stages, mean, factor = [VectorAssembler(inputCols=cols, outputCol="raw" if spec.scaled else "features")], np.zeros(d), np.ones(d)
    if spec.scaled:
        one = F.explode(F.expr("sequence(1, cast(_w as int))"))
        few = rows.select(*rows.columns, one.alias("_r")).select(F.array(*[f"_x{i}" for i in range(d)]).alias("_a")).select(array_to_vector("_a").alias("raw"))
        scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(few)
        sd = scaler.std.toArray()
        mean, factor = scaler.mean.toArray(), np.where(sd != 0, 1.0 / np.where(sd != 0, sd, 1.0), 0.0)
        stages.append(scaler)
    return PipelineModel([*stages, N.fit(est, rows, mean, factor)])


def predict_scores(m, df: DataFrame, row_id: str = "row_id", out: str = "score") -> DataFrame:
    """M9."""
    if isinstance(m, Constant):
        return df.withColumn(out, m.score(df, row_id))
    keep = df.columns
    if isinstance(m.model, H.Trees):
        return df.withColumn(out, m.model.probability(df, m.cols))
    p = m.model.transform(df)
    return p.select(*keep, vector_to_array("probability")[1].alias(out))


def ladder_scores(train: DataFrame, tests: dict[str, DataFrame], cols: list[str], specs, seed: int = 11,
                  row_id: str = "row_id", keep=("row_id", "y", "category", "grp")) -> DataFrame:
    """M21 core. Fit every spec once and score every domain: (model, domain, keep…, score).

    Models are fitted side by side, each on the whole table. Training and scores read `train` and
    `tests` as they come, so a corpus should be stored before it is cut into them.
    """
    parts, counts, specs = [], class_counts(train), list(specs)
    fit = inheritable_thread_target(train.sparkSession)(lambda spec: fit_model(spec, train, cols, seed, row_id, counts=counts))
    with ThreadPoolExecutor(4) as pool:
        models = list(pool.map(fit, specs))
    for spec, m in zip(specs, models):
        for name, d in tests.items():
            s = predict_scores(m, d, row_id).select(F.lit(spec.key).alias("model"), F.lit(name).alias("domain"), *keep, "score")
            parts.append(s)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- novelty
def isolation_forest(benign: DataFrame, cols: list[str], row_id: str, n_trees: int = 200, sample: int = 256,
                     seed: int = 11) -> pd.DataFrame:
    """M19, fit. Each tree reads `sample` rows in the hash order of its own seed and is built
    in its own task. The forest is at most n_trees · 2 · sample nodes, so it may be broadcast.

    A row enters a tree's candidate set when its hash is below a cut that keeps a few times
    the sample, so the table is read once and not once per tree.
    """
    n = benign.count()
    depth = int(np.ceil(np.log2(max(min(sample, n), 2))))
    cut = min(1.0, 4.0 * sample / max(n, 1))
    pick = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                    lambda t: S.hash_unit(F.lit(f"if{seed}"), t, F.col(row_id)) < F.lit(cut))
    d = benign.select(F.col(row_id).cast("string").alias("_id"), F.array(*[S.dbl(c) for c in cols]).alias("_v"),
                      F.explode(pick).alias("tree"))
    d = d.withColumn("_h", S.hash_int(F.lit(f"if{seed}"), "tree", "_id"))

    def grow(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_h", "_id"]).head(sample)
        x = np.stack(g["_v"].to_numpy())
        rng = np.random.default_rng([seed, int(key[0])])
        nodes = []

        def build(idx: np.ndarray, level: int) -> int:
            me = len(nodes)
            nodes.append([int(key[0]), me, -1, 0.0, -1, -1, len(idx)])
            lo, hi = x[idx].min(0), x[idx].max(0)
            live = np.flatnonzero(hi > lo)
            if level < depth and len(idx) > 1 and len(live):
                f = int(rng.choice(live))
                t = float(rng.uniform(lo[f], hi[f]))
                left = x[idx, f] < t
                if left.any() and not left.all():
                    nodes[me][2], nodes[me][3] = f, t
                    nodes[me][4] = build(idx[left], level + 1)
                    nodes[me][5] = build(idx[~left], level + 1)
            return me
        build(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    schema = "tree int, node int, feature int, cut double, left int, right int, size int"
    return d.groupBy("tree").applyInPandas(grow, schema).toPandas()


def isolation_scores(df: DataFrame, cols: list[str], forest: pd.DataFrame, sample: int = 256, out: str = "score") -> DataFrame:
    """M19, score. 2^(-mean depth / c(n)); higher is more anomalous."""
    def c(n):
        n = np.asarray(n, float)
        return np.where(n > 2, 2.0 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2.0 * (n - 1) / np.maximum(n, 1),
                        np.where(n == 2, 1.0, 0.0))
    trees = []
    for _, g in forest.sort_values(["tree", "node"]).groupby("tree"):
        trees.append(tuple(g[k].to_numpy() for k in ("feature", "cut", "left", "right", "size")))
    norm = float(c(min(sample, max(int(t[4][0]) for t in trees))))
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def run(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(float) for s in xs])
        total = np.zeros(len(x))
        for f, t, left, right, size in shared.value:
            node = np.zeros(len(x), int)
            depth = np.zeros(len(x))
            live = f[node] >= 0
            while live.any():
                n = node[live]
                go = x[live, f[n]] < t[n]
                node[live] = np.where(go, left[n], right[n])
                depth[live] += 1
                live = f[node] >= 0
            total += depth + c(size[node])
        return pd.Series(2.0 ** (-(total / len(shared.value)) / norm))
    return df.withColumn(out, run(*[S.dbl(k) for k in cols]))


def reconstruction_scores(benign: DataFrame, dfs: list[DataFrame], cols: list[str], k: int = 6, out: str = "score") -> list[DataFrame]:
    """M20. Mean squared error of a k-component reconstruction of the z-scored row."""
    va = VectorAssembler(inputCols=cols, outputCol="_x")
    sc = StandardScaler(withMean=True, inputCol="_x", outputCol="_z").fit(va.transform(benign))
    prep = lambda d: sc.transform(va.transform(d))                        # noqa: E731
    pc = PCA(k=min(k, len(cols)), inputCol="_z", outputCol="_p").fit(prep(benign)).pc.toArray()
    resid = np.eye(len(cols)) - pc @ pc.T                                 # z - P Pᵀ z

    def score(d: DataFrame) -> DataFrame:
        z = vector_to_array("_z")
        e = [S.row_total([z[i] * float(resid[i, j]) for i in range(len(cols))]) for j in range(len(cols))]
        return prep(d).withColumn(out, S.row_total([x * x for x in e]) / len(cols)).drop("_x", "_z")
    return [score(d) for d in dfs]


def novelty_threshold(scores: DataFrame, q: float = NOVELTY_QUANTILE, score: str = "score") -> float:
    """M19, M20. The quantile of the benign training scores."""
    return float(O.exact_percentiles(scores.select(S.dbl(score).alias("_s")), "_s", {"q": q}).first()["q"])


# ----------------------------------------------------------------- k-NN vote
def knn_scores(train: DataFrame, test: DataFrame, cols: list[str], row_id: str, k: int = 5, y: str = "y") -> DataFrame:
    """M10. Share of attacks among the k nearest training rows of the z-scored columns."""
    from .joins import nearest_neighbour, standardise
    v = F.array(*[S.dbl(c) for c in cols]).alias("_vec")
    tr, te = standardise(train.select(F.col(row_id).alias("_nn"), v, F.col(y).alias("_ny")), [test.select(row_id, v)], "_vec", len(cols))
    nn = nearest_neighbour(tr, te, "_vec", "_nn", row_id, k=k)
    s = nn.join(tr.select("_nn", "_ny"), "_nn").groupBy(row_id).agg(F.avg("_ny").alias("score"))
    return test.join(s, row_id)
