"""Registered fits run with the whole of their specs: trees, rounds, models, repeats."""
import pytest
from pyspark.sql import functions as F

from flowaudit.functions import ordered as O
from flowaudit.operators import audit as A
from flowaudit.operators import models as M
from flowaudit.operators import space as SP
from flowaudit.operators import trees as H
from flowaudit.plans import experiments as E
from flowaudit.plans import learning as L
from flowaudit.plans.catalog import QUERIES
from flowaudit.session import shuffles_dropped


class Seen(Exception):
    """Ends a query once it has said what it runs."""


def stop(seen):
    def run(*a, **k):
        seen.append((a, k))
        raise Seen
    return run


def asked(monkeypatch, spark, name, owner, fn):
    """The arguments with which a query calls a function; the tables before it are empty."""
    seen, empty = [], spark.createDataFrame([], "row_id string, y int, category string, grp string")
    for c in SP.SHARED_COLUMNS:
        empty = empty.withColumn(c, F.lit(0.0))
    for table in ("_zeek", "_argus"):
        monkeypatch.setattr(L, table, lambda *a, **k: empty)
    monkeypatch.setattr(owner, fn, stop(seen))
    with pytest.raises(Seen):
        QUERIES[name](spark, "none")
    return seen[0]


def built(spec):
    return spec.build(10, 11)


def test_boosted_scores_runs_all_rounds(spark, monkeypatch):
    (_, _, _, specs), _ = asked(monkeypatch, spark, "boosted_scores", M, "ladder_scores")
    assert [(s.key, built(s).getMaxIter(), built(s).getMaxDepth()) for s in specs] == [("xgboost", 300, 6), ("hgb", 300, 6)]


@pytest.mark.parametrize("key", ["rf", "xgboost", "hgb"])
def test_whole_tables_give_the_trees_of_passes(spark, monkeypatch, key):
    """A small table is handed to the tasks whole; the trees are those of one pass a level, draws included."""
    params = {"numTrees": 3, "maxDepth": 6} if key == "rf" else {"maxIter": 4, "maxDepth": 4}
    d = spark.range(600).selectExpr("cast(id as string) row_id", "id % 7 / 1.0 a", "(id * 37) % 101 / 1.0 b", "(id * 11) % 13 / 1.0 c",
                                    "cast((id * 37) % 101 + id % 7 * 9 > 70 as int) y").repartition(3, "row_id").persist()
    spec, cols = E.with_params(M.BY_KEY[key], **params), ["a", "b", "c"]
    whole = M.fit_model(spec, d, cols).model
    monkeypatch.setattr(H, "WHOLE_BYTES", 0)
    monkeypatch.setattr(H, "DRIVER_BYTES", 0)
    passes = M.fit_model(spec, d, cols).model
    assert len(whole.trees) == len(passes.trees) == (3 if key == "rf" else 4)
    a, b = (d.select(m.probability(d, cols).alias("p"), "row_id").orderBy("row_id").toPandas()["p"] for m in (whole, passes))
    assert a.nunique() > 10 and (a - b).abs().max() < 1e-9


def test_domain_classifier_runs_all_rounds(spark, monkeypatch):
    (est, *_), _ = asked(monkeypatch, spark, "domain_classifier", H, "fit_folds")
    assert est.getMaxIter() == 200


def test_exporter_domains_runs_all_rounds(spark, monkeypatch):
    (est, *_), _ = asked(monkeypatch, spark, "exporter_domains", H, "fit_folds")
    assert est.getMaxIter() == 200


def test_forest_scores_grows_the_whole_forest(spark, monkeypatch):
    (_, _, _, (spec,)), _ = asked(monkeypatch, spark, "forest_scores", M, "ladder_scores")
    assert (built(spec).getNumTrees(), built(spec).getMaxDepth(), built(spec).getMinInstancesPerNode()) == (200, 30, 2)


def test_published_scores_fits_all_five(spark, monkeypatch):
    names = [c for c in SP.SHARED_COLUMNS if c not in SP.PROTO_COLUMNS]
    monkeypatch.setattr(L.SH, "anova_f", lambda *a: spark.createDataFrame([(c, float(i)) for i, c in enumerate(names)], "feature string, f double"))
    scored = spark.createDataFrame([("1", 1, "x", "g", 0.9, m) for m in M.PUBLISHED], "row_id string, y int, category string, grp string, score double, model string")
    asks, votes = [], []

    def ladder(train, tests, cols, specs):
        asks.extend((s.key, built(s)) for s in specs)
        return scored.withColumn("domain", F.lit("test")).select("model", "domain", "row_id", "y", "category", "grp", "score")
    monkeypatch.setattr(M, "ladder_scores", ladder)
    monkeypatch.setattr(M, "knn_scores", lambda *a, **k: votes.append(a) or scored.drop("model").limit(1))
    monkeypatch.setattr(L, "_fold", lambda *a: (scored, scored))
    got = {r.model for r in QUERIES["published_scores"](spark, "none").collect()}
    est = dict(asks)
    assert got == {"dt", "rf", "nb", "mlp", "knn"} and len(votes) == 1
    assert est["dt"].getMaxDepth() == est["rf"].getMaxDepth() == 30 and est["rf"].getNumTrees() == 100 and est["mlp"].getMaxIter() == 100


def test_published_run_repeats_and_fits_the_whole(spark, monkeypatch):
    monkeypatch.setattr(L.X, "published_flows", lambda *a: spark.range(1))
    (_, _, sets, specs), more = asked(monkeypatch, spark, "published_run", E, "published_run")
    assert not more and len(sets) == 2                              # five repeats, five folds and five neighbours are the run's own
    est = {s.key: built(s) for s in specs}
    assert set(est) == {"dt", "rf", "nb", "mlp"} and est["rf"].getNumTrees() == 100 and est["mlp"].getMaxIter() == 100
    assert est["dt"].getMaxDepth() == est["rf"].getMaxDepth() == 30


def test_bootstrap_mean_draws_ten_thousand(spark, tmp_path):
    spark.createDataFrame([(i % 2, i, float(i)) for i in range(8)], "s_nationkey int, s_suppkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert [r.n_boot for r in QUERIES["bootstrap_mean"](spark, str(tmp_path)).collect()] == [10_000] * 2


def test_permutation_null_has_every_step(spark, monkeypatch):
    """Twenty replicates, the excess and the size-matched groups; a replicate at a time gives the same."""
    d = spark.range(400).selectExpr("cast(id as string) row_id", "cast(id % 20 as string) grp", "cast(id % 20 < 8 or id % 3 = 0 as int) y").persist()
    r = A.permutation_null(d, "grp", "y", "row_id").first()
    assert r.reps == 20 and abs(r.nmi_excess_over_null - (r.nmi - r.nmi_null_mean)) < 1e-12
    assert r.nmi > 3 * max(r.nmi_null_p95, r.nmi_sizematched_null) and r.nmi_null_p95 > r.nmi_null_mean > 0
    monkeypatch.setattr(A, "REPLICATE_ROWS", 4000)                  # two turns of ten
    again = A.permutation_null(d, "grp", "y", "row_id").first()
    assert all(abs(a - b) < 1e-12 for a, b in zip(r, again))


def test_shuffles_of_a_replicate_are_dropped(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()      # noqa: E731
    before = files()
    d = shuffles_dropped(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= before and d.count() == 7


def test_exporter_features_in_turns(spark, monkeypatch):
    """A feature at a time gives the same, and frees what it stored."""
    a = spark.range(200).selectExpr("id % 13 / 1.0 x", "id * 7 % 101 / 1.0 y")
    b = spark.range(150).selectExpr("id % 11 / 1.0 x", "id * 5 % 90 / 1.0 y")
    rows = lambda: E.exporter_features(a, b, ["x", "y"], ["x"]).orderBy("feature").collect()      # noqa: E731
    stored = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()                          # noqa: E731
    before, kept, one = stored(), [], E._features
    whole = rows()
    monkeypatch.setattr(E, "VALUES_AT_ONCE", 350)
    monkeypatch.setattr(E, "_features", lambda a, b, cols, r: kept.append((cols, stored())) or one(a, b, cols, r))
    assert rows() == whole and len(whole) == 2
    assert kept == [([c], before) for c in "xy"] and stored() == before


def test_released_frees_only_its_own(spark):
    out = O.cached(spark.range(3))
    with O.released():
        inner = O.cached(spark.range(4))
        assert inner.storageLevel.useMemory
    assert not inner.storageLevel.useMemory and out.storageLevel.useMemory
    out.unpersist()
