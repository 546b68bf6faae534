"""Queries that fit models. Fits have no SQL twin, so their results are rows only."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calibrate as K
from ..operators import counts as C
from ..operators import models as M
from ..operators import shift as SH
from ..operators import space as SP

from . import bindings as X
from . import experiments as E
from . import telemetry as T
from .registry import LI, SCORES, counts_sql, query, r6, u

FINE = "[" + ", ".join(f"{t!r}e0" for t in C.TAU_FINE) + "]"
COLS = SP.SHARED_COLUMNS
KEEP = ["row_id", "y", "category", "grp"]
LIGHT = [M.BY_KEY[k] for k in ("majority", "stratified", "logreg", "tree")]


def _zeek(spark, d, extra=()):
    return SP.shared_from_zeek(X.zeek_flows(spark, d, stored=True), [*KEEP, *extra])


def _argus(spark, d):
    return SP.shared_from_argus(X.argus_flows(spark, d).persist(), KEEP)


def _fold(spark, d, extra=()):
    z = _zeek(spark, d, extra).withColumn("_t", S.hash_unit(F.lit("fold"), "grp") < 0.2)
    return z.filter(~F.col("_t")).drop("_t"), z.filter("_t").drop("_t")


def _counts_of(s, keys):
    return C.detection_metrics(C.confusion(s.withColumn("pred", C.predict()), keys))


@query("ladder_scores")
def ladder_scores(spark, d):
    """M1-M4, M8, M9: scores of the light end of the ladder on both corpora, as runs."""
    tr, te = _fold(spark, d)
    s = M.ladder_scores(tr, {"source_heldout": te, "target": _argus(spark, d)}, COLS, LIGHT)
    return r6(E.runs_of(s, ["model", "domain"]))


@query("forest_scores")
def forest_scores(spark, d):
    """M5: the ladder's forest."""
    tr, te = _fold(spark, d)
    return r6(_counts_of(M.ladder_scores(tr, {"source_heldout": te}, COLS, [M.BY_KEY["rf"]]), ["model", "domain"]))


@query("boosted_scores")
def boosted_scores(spark, d):
    """M6: both boosted configurations."""
    tr, te = _fold(spark, d)
    specs = [M.BY_KEY[k] for k in ("xgboost", "hgb")]
    return r6(_counts_of(M.ladder_scores(tr, {"source_heldout": te}, COLS, specs), ["model", "domain"]))


@query("mlp_scores")
def mlp_scores(spark, d):
    """M7: 20 iterations."""
    tr, te = _fold(spark, d)
    return r6(_counts_of(M.ladder_scores(tr, {"source_heldout": te}, COLS, [E.with_params(M.BY_KEY["mlp"], maxIter=20)]), ["model", "domain"]))


@query("published_scores")
def published_scores(spark, d):
    """All five models on the z-scored columns with the largest F."""
    tr, te = _fold(spark, d)
    f = SH.anova_f(tr, [c for c in COLS if c not in SP.PROTO_COLUMNS])
    top = [r[0] for r in f.orderBy(F.col("f").desc(), "feature").limit(10).collect()]
    s = M.ladder_scores(tr, {"test": te}, top, M.PUBLISHED.values())
    vote = M.knn_scores(tr, te, top, "row_id").select(F.lit("knn").alias("model"), F.lit("test").alias("domain"), *KEEP, "score")
    return r6(_counts_of(s.unionByName(vote), ["model", "domain"]))


KNN = f"""v AS (SELECT vec_id AS id, label % 2 AS y, {u("'knn|' || vec_id")} < 0.2e0 AS test, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM v WHERE NOT test GROUP BY i), z AS (SELECT id, y, test, i, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS x FROM v JOIN st USING (i)),
ds AS (SELECT q.id AS q, t.id AS t, max(q.y) AS qy, max(t.y) AS ty, sum((q.x - t.x) * (q.x - t.x)) AS d FROM z q JOIN z t ON q.i = t.i AND q.test AND NOT t.test GROUP BY q.id, t.id),
nn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rn FROM ds)"""


@query("knn_scores", f"WITH {KNN} SELECT q AS row_id, max(qy) AS y, round(avg(ty), 6) AS score FROM nn WHERE rn <= 5 GROUP BY q")
def knn_scores(spark, d):
    """The share of attacks among five exact neighbours."""
    e = X.table(spark, d, "embeddings").withColumn("y", F.pmod("label", F.lit(2)))
    dim = len(e.select("embedding").first()[0])
    cols = [f"x{i}" for i in range(dim)]
    e = e.select(F.col("vec_id").alias("row_id"), "y", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    test = S.hash_unit(F.lit("knn"), "row_id") < 0.2
    s = M.knn_scores(e.filter(~test), e.filter(test), cols, "row_id", 5)
    return s.select("row_id", "y", F.round("score", 6).alias("score"))


@query("calibrated_scores")
def calibrated_scores(spark, d):
    """Every calibrator on the calibration fold of the stored scores, for each model and split.

    Fits read the counted distinct scores of the fold, kept once, and run side by side; the
    target's scores are kept with what the measures read, and each is calibrated in all ways at once.
    """
    kinds, by = ("raw", "platt", "isotonic", "temperature"), ["model", "split_seed"]
    s = X.scores(spark, d).select(*by, "domain", "row_id", "y", "score")
    cal = C.score_table(s.filter("domain = 'source_heldout'"), by).persist()
    tgt = s.filter("domain = 'target'").drop("domain").persist()
    of = lambda t, m, seed: t.filter((F.col("model") == m) & (F.col("split_seed") == seed))       # noqa: E731
    todo = [(m, seed, kind) for m in X.MODELS for seed in X.SEEDS for kind in kinds]
    fit = inheritable_thread_target(spark)(lambda x: K.fit_calibrator(None, x[2], table=of(cal, x[0], x[1]).select("score", "pos", "neg")))
    with ThreadPoolExecutor(8) as pool:
        use = dict(zip(todo, pool.map(fit, todo)))
    parts = []
    for m in X.MODELS:
        for seed in X.SEEDS:
            mine = of(tgt, m, seed)
            for kind in kinds:
                mine = use[m, seed, kind](mine).withColumnRenamed("calibrated", f"_{kind}")
            each = F.explode(F.array(*[F.struct(F.lit(kind).alias("calibrator"), F.col(f"_{kind}").alias("score")) for kind in kinds]))
            parts.append(mine.select(*by, "row_id", "y", each.alias("_x")).select(*by, "_x.calibrator", "row_id", "y", "_x.score"))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    k = ["model", "split_seed", "calibrator"]
    return r6(C.ece(out, k, ["row_id"]).join(C.brier(out, k), k).join(C.rank_metrics(out, k), k))


@query("coral")
def coral(spark, d):
    """Means and spreads of the re-coloured source beside the target's."""
    cols = SP.ROBUST_COLUMNS[4:]
    s, t = SH.coral(_zeek(spark, d), _argus(spark, d), cols)
    m = lambda x, n: SH.melt(x, cols).groupBy("feature").agg(F.avg("value").alias(f"{n}_mean"), F.stddev_pop("value").alias(f"{n}_sd"))      # noqa: E731
    return r6(m(s, "source").join(m(t, "target"), "feature"))


@query("importance_weights")
def importance_weights(spark, d):
    """Diagnostics of the density ratio."""
    _, diag = SH.importance_weights(_zeek(spark, d), _argus(spark, d), SP.ROBUST_COLUMNS[4:], "row_id", 101)
    return r6(diag)


@query("domain_classifier")
def domain_classifier(spark, d):
    """Five stratified folds."""
    return r6(SH.domain_classifier(_zeek(spark, d), _argus(spark, d), SP.ROBUST_COLUMNS, "row_id"))


@query("novelty")
def novelty(spark, d):
    """M19, M20 with 50 trees."""
    tr, te = _fold(spark, d)
    s = E.novelty_run(tr, {"source_heldout": te, "target": _argus(spark, d)}, COLS[:7] + COLS[11:], n_trees=50)
    hit = (F.col("score") >= F.col("threshold")).cast("int")
    g = C.detection_metrics(C.confusion(s.withColumn("pred", hit), ["model", "domain"]))
    return r6(g)


@query("transfer_run")
def transfer_run(spark, d):
    """One split of the light ladder, plain."""
    s = E.transfer_run(spark, _zeek(spark, d), {"target": _argus(spark, d)}, COLS, LIGHT[2:], [101])
    return r6(_counts_of(s, ["model", "split_seed", "domain"]))


@query("transfer_run_coral")
def transfer_run_coral(spark, d):
    """M21 with M16 on the robust columns."""
    s = E.transfer_run(spark, _zeek(spark, d), {"target": _argus(spark, d)}, SP.ROBUST_COLUMNS[4:], LIGHT[2:], [101], adapt="coral")
    return r6(_counts_of(s, ["model", "split_seed", "domain"]))


@query("leakage_run")
def leakage_run(spark, d):
    """Three protocols, one split and one model seed."""
    s = E.leakage_run(spark, _zeek(spark, d), COLS, [LIGHT[3]], [101], (11,))
    return r6(_counts_of(s, ["protocol", "model", "split_seed"]))


@query("in_target_reference")
def in_target_reference(spark, d):
    """Leave one capture file out."""
    z = _zeek(spark, d, ("file", "is_copy"))
    s = E.in_target_reference(spark, z, COLS, [LIGHT[3]], "lofo")
    return r6(_counts_of(s, ["unit", "model"]))


@query("label_efficient_run")
def label_efficient_run(spark, d):
    """One draw of two files."""
    z = _zeek(spark, d, ("file", "is_copy"))
    s = E.label_efficient_run(spark, z, z, COLS, [LIGHT[3]], [2], 1)
    return r6(_counts_of(s, ["k", "draw", "variant", "model", "domain"]))


@query("grouping_confound_run")
def grouping_confound_run(spark, d):
    """Source groups, an oracle grouping by category, and a random split."""
    s = E.grouping_confound_run(spark, _zeek(spark, d), COLS, [LIGHT[3]], {"source": "grp", "oracle": "category"}, [101])
    return r6(_counts_of(s, ["grouping", "split_seed", "model"]))


def _windows(spark, d):
    """Windows of 16 records by device; blocks of devices stand for sessions in time order."""
    f = T.W.window_features(T._windows(spark, d), ["user_id"], ["value", "counter"], "event_type", "y")
    return f.select(F.concat_ws("-", F.col("user_id").cast("string"), F.col("w").cast("string")).alias("row_id"), (F.pmod("user_id", F.lit(15))).alias("session"),
                    F.pmod("user_id", F.lit(15)).cast("string").alias("grp"), (F.col("category") == "error").cast("int").alias("y"), "category",
                    "value_mean", "value_std", "counter_mean", "counter_std")


@query("drift_run")
def drift_run(spark, d):
    """Temporal against one random control."""
    w = _windows(spark, d)
    s = E.drift_run(spark, w, w.select("session").distinct(), ["value_mean", "value_std", "counter_mean", "counter_std"], [LIGHT[3]], [0.5], 1)
    return r6(_counts_of(s, ["protocol", "direction", "rep", "model"]))


@query("alert_burden_run", f"""WITH {SCORES}, {counts_sql('model, split_seed, "file"', '(SELECT * FROM scores WHERE "domain" = \'target\') t', FINE)}
SELECT model, split_seed, "file", tau, tp, fp, fn, tn FROM counts""")
def alert_burden_run(spark, d):
    """Counts on the fine grid by capture file."""
    return E.alert_burden_run(X.scores(spark, d).filter("domain = 'target'"), ["model", "split_seed"], "file")


@query("consolidate")
def consolidate(spark, d):
    """The runs of every view from stored scores."""
    return r6(E.consolidate(X.scores(spark, d), ["target"])["runs"])


@query("platt_diagnosis")
def platt_diagnosis(spark, d):
    """One seed."""
    return r6(E.platt_diagnosis(spark, _zeek(spark, d), COLS, LIGHT[3], [101]))


@query("robustness_run")
def robustness_run(spark, d):
    """Three attacks at two strengths on a tree."""
    z = X.zeek_flows(spark, d, stored=True).withColumn("ok", F.split_part("row_id", F.lit("-"), F.lit(1)).cast("long"))
    z = SP.shared_from_zeek(z, [*KEEP, "ok"]).withColumn("_t", S.hash_unit(F.lit("fold"), "grp") < 0.2)
    return r6(E.robustness_run(z.filter(~F.col("_t")), z.filter("_t"), COLS, [LIGHT[3]], 101, ["ok", "row_id"],
                               attacks=["scaling_attack", "stale_telemetry", "evasion_constrained"], eps=[0.0, 0.25]))


@query("poisoning_run")
def poisoning_run(spark, d):
    """Two rates."""
    tr, te = _fold(spark, d)
    return r6(E.poisoning_run(tr, te, COLS, [LIGHT[3]], 101, rates=[0.0, 0.25]))


@query("calibration_runs")
def calibration_runs(spark, d):
    """A tree under two calibrators."""
    s = E.calibration_runs(spark, _zeek(spark, d), _argus(spark, d), COLS, [LIGHT[3]], [101], kinds=("raw", "platt"))
    return r6(_counts_of(s, ["seed", "model", "domain", "calibrator"]))


PUBLISHED_TOP = ["Seq", "Offset", "SrcBytes", "TotBytes", "DstBytes", "SrcPkts", "TotPkts", "Dur", "tcp", "icmp"]
NO_POSITION = [c for c in PUBLISHED_TOP if c not in ("Seq", "Offset")] + ["DstPkts", "udp"]


@query("published_run")
def published_run(spark, d):
    """All rungs, both feature sets, all five models and all repeats."""
    s = E.published_run(spark, X.published_flows(spark, d).persist(), {"published_top10": PUBLISHED_TOP, "no_position_top10": NO_POSITION}, M.PUBLISHED.values())
    return r6(E.published_summary(s))


NATIVE = ["bidirectional_duration_ms", "src2dst_bytes", "dst2src_bytes", "src2dst_packets", "dst2src_packets", "protocol", "tunnel_id"]
PORTABLE = ["protocol", "src2dst_packets", "dst2src_packets"]


def _third(spark, d):
    n = X.nfstream_flows(spark, d)
    shared = SP.shared_from_nfstream(n.select("*", *[F.col(c).alias(f"n_{c}") for c in NATIVE]), [*KEEP, "file", *[f"n_{c}" for c in NATIVE]])
    return shared.persist(), {"shared18": COLS, "native": [f"n_{c}" for c in NATIVE]}


@query("third_corpus_run")
def third_corpus_run(spark, d):
    """M23 on the third corpus: both protocols and feature sets with a tree, one seed of the random split."""
    corpus, sets = _third(spark, d)
    s = E.third_corpus_run(spark, corpus, sets, [LIGHT[3]], [101])
    return r6(_counts_of(s, ["feature_set", "protocol", "split", "model"]))


def _ceiling_sql(name: str, cols: list[str]) -> str:
    c = ", ".join(cols)
    return f"""(WITH g AS (SELECT {c}, count(*) AS n, sum(y) AS n1, count(*) - sum(y) AS n0 FROM nf GROUP BY {c}), t AS (SELECT sum(n1) AS s1, sum(n0) AS s0 FROM g),
p AS (SELECT g.*, (n1 / s1::DOUBLE > n0 / s0::DOUBLE)::INT AS p, (n1 > 0 AND n0 > 0)::INT AS mx FROM g, t)
SELECT '{name}' AS feature_set, {len(cols)} AS n_features, count(*) AS n_distinct, sum(mx * n)::BIGINT AS flows_in_conflicting, round(sum(mx * n) / sum(n)::DOUBLE, 6) AS share_in_conflicting,
  round(sum(mx * n1) / sum(n1)::DOUBLE, 6) AS attack_share_in_conflicting, round((sum(p * n1) / sum(n1)::DOUBLE + sum((1 - p) * n0) / sum(n0)::DOUBLE) / 2, 6) AS ba_ceiling FROM p)"""


@query("third_corpus_ceilings", f"""WITH {LI}, nf AS (SELECT y, l_suppkey AS bidirectional_duration_ms, l_extendedprice AS src2dst_bytes, l_extendedprice / 10 AS dst2src_bytes, l_quantity AS src2dst_packets,
  l_linenumber AS dst2src_packets, l_partkey % 4 AS protocol, (l_tax > 0.04e0)::INT AS tunnel_id FROM li) {_ceiling_sql('native', NATIVE)} UNION ALL {_ceiling_sql('portable', PORTABLE)}""")
def third_corpus_ceilings(spark, d):
    """A25 for two feature sets of the third corpus."""
    return r6(E.feature_set_ceilings(X.nfstream_flows(spark, d), {"native": NATIVE, "portable": PORTABLE}))


@query("exporter_domains")
def exporter_domains(spark, d):
    """M18 in the run on exporter sensitivity: shared and robust features, five folds."""
    return r6(E.exporter_sensitivity(_zeek(spark, d), _argus(spark, d), {"shared": COLS, "robust": SP.ROBUST_COLUMNS})["domain"])


@query("exporter_features")
def exporter_features(spark, d):
    """A36-A38 of every shared feature, W1 on the source's quantiles."""
    return r6(E.exporter_features(_zeek(spark, d), _argus(spark, d), COLS, SP.ROBUST_COLUMNS))
