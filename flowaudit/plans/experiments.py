"""Runs: splits, fits and scores, reduced to counts by the operators.

A run is a list of units, each with a training table and the tables to score. The driver
loops over units and models; every fit and every score is a Spark job over the whole
tables. With `store` each unit's scores are appended to a Parquet store as soon as they
exist, so a lost driver loses one score table; a re-run skips what is there.
"""
from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S
from ..operators import audit as A
from ..operators import calibrate as K
from ..operators import counts as C
from ..operators import models as M
from ..operators import perturb as R
from ..operators import shift as SH
from ..operators import splits as D
from ..session import checkpoint, dropping_shuffles
from ..sources import sinks

KEEP = ["row_id", "y", "category", "grp"]
VALUES_AT_ONCE = 1 << 25     # values of features that are counted in one turn


@dataclass
class Unit:
    keys: dict
    train: DataFrame
    tests: dict[str, DataFrame]
    weight: str | None = None
    cols: list[str] | None = None         # of this unit alone; else the run's
    specs: tuple | None = None
    plain: bool = False                   # `train` is a filter of a stored corpus, so it is read from there and not stored again


@dataclass
class Neighbours:
    """M10's vote of the k nearest training rows, as a model of a run."""
    k: int = 5
    key: str = "knn"


def with_params(spec: M.ModelSpec, **params) -> M.ModelSpec:
    """The same spec with other estimator parameters."""
    return replace(spec, build=lambda d, s: spec.build(d, s).setParams(**params))


def run_units(spark: SparkSession, units: Iterable[Unit], cols: list[str], specs, model_seeds=(11,), store: str | None = None,
              keep=KEEP, parallel: int = 4) -> DataFrame:
    """Fit and score every unit: (unit keys…, model_seed, model, domain, keep…, score).

    The models of a unit are fitted `parallel` at a time. Unless the unit is `plain`, the columns
    they read are stored while they are fitted, and freed before the next unit; scores are read
    from the unit's tables, so the corpus should be stored by the caller. Score tables are
    written one after the other.
    """
    parts, done = [], set()
    one = ["unit_key", "model_seed", "model", "domain"]
    if store:
        old = sinks.read_or_none(spark, store)
        if old is not None:
            done = {tuple(r) for r in old.select(*one).distinct().collect()}          # one row a score table
    for u in units:
        key = "|".join(f"{k}={v}" for k, v in sorted(u.keys.items()))
        use, todo = u.cols or cols, [(ms, spec) for ms in model_seeds for spec in u.specs or specs
                                     if any((key, ms, spec.key, name) not in done for name in u.tests)]
        if not todo:
            continue
        ids = any(isinstance(spec, Neighbours) or spec.balance == "sample" or spec.build is None for _, spec in todo)
        train = u.train.select(*dict.fromkeys([*use, "y", *(["row_id"] if ids else []), *([u.weight] if u.weight else [])]))
        if not u.plain:
            train = train.persist()
        n1, n0 = M.class_counts(train)
        if n1 == 0 or n0 == 0:               # a single class cannot be fitted
            train.unpersist()
            continue
        fit = inheritable_thread_target(spark)(lambda x: None if isinstance(x[1], Neighbours) else M.fit_model(
            x[1], train, use, x[0], extra_weight=u.weight, counts=(n1, n0)))
        with ThreadPoolExecutor(parallel) as pool:
            models = list(pool.map(fit, todo))
        vote = any(m is None for m in models)              # the vote reads the training rows when scores are read
        if not vote:
            train.unpersist()
        for (ms, spec), m in zip(todo, models):
            for name, d in u.tests.items():
                if (key, ms, spec.key, name) in done:
                    continue
                s = M.knn_scores(train, d, use, "row_id", spec.k) if m is None else M.predict_scores(m, d)
                s = s.select(F.lit(key).alias("unit_key"), *[F.lit(v).alias(k) for k, v in u.keys.items()], F.lit(ms).alias("model_seed"),
                             F.lit(spec.key).alias("model"), F.lit(name).alias("domain"), *keep, "score")
                if store:
                    sinks.write_table(s, store, mode="append")
                else:
                    parts.append(s)
        if store and vote:
            train.unpersist()
    return spark.read.parquet(store) if store else reduce(lambda a, b: a.unionByName(b), parts)


def runs_of(scores: DataFrame | None, keys: list[str], tau: float = 0.5, ranks: bool = True, table: DataFrame | None = None) -> DataFrame:
    """The runs table of a score table. With `ranks` scores are read once, into stored counts of distinct scores, or come as such (`table`)."""
    if not ranks:
        return C.detection_metrics(C.confusion(scores.withColumn("pred", C.predict("score", tau)), keys))
    t = C.score_table(scores, keys).persist() if table is None else table
    r = C.detection_metrics(C.table_metrics(t, keys, tau)).join(C.rank_metrics(None, keys, table=t).drop("n_pos", "n_neg"), keys)
    return r.select(*[c for c in r.columns if c != "brier"], "brier")


def _source_split(src: DataFrame, seed: int, n_sub: int | None, grp: str = "grp") -> tuple[DataFrame, DataFrame]:
    d = D.subsample(src, n_sub, seed, "row_id") if n_sub else src
    a = D.balanced_group_split(D.group_summary(d, grp), [seed])
    D.check_disjoint(a)
    rows = D.apply_split(d, a, grp)
    return rows.filter("side = 'train'").drop("side", "split_seed"), rows.filter("side = 'test'").drop("side", "split_seed")


def transfer_run(spark: SparkSession, source: DataFrame, targets: dict[str, DataFrame], cols: list[str], specs, seeds: list[int],
                 n_sub: int | None = None, adapt: str | None = None, store: str | None = None) -> DataFrame:
    """M21. Per seed: subsample, group split, adapt, fit the ladder, score the source fold and the targets."""
    def units():
        for seed in seeds:
            tr, te = _source_split(source, seed, n_sub)
            tests, weight = {"source_heldout": te, **targets}, None
            if adapt == "coral":
                (name, t), = targets.items()
                tr2, t2 = SH.coral(tr, t, cols)
                tests = {"source_heldout": _coral_like(tr, te, t, cols), name: t2}
                tr = tr2
            elif adapt == "iw":
                (name, t), = targets.items()
                tr, _ = SH.importance_weights(tr, t, cols, "row_id", seed)
                tr, weight = tr.withColumnRenamed("weight", "iw"), "iw"
            yield Unit({"split_seed": seed}, tr, tests, weight)
    return run_units(spark, units(), cols, specs, store=store)


def leakage_run(spark: SparkSession, corpus: DataFrame, cols: list[str], specs, seeds: list[int], model_seeds=(11, 12),
                protocols=("random", "group_disjoint", "stratified_group"), store: str | None = None) -> DataFrame:
    """M22. The same corpus under three protocols."""
    groups = D.group_summary(corpus, "grp", "y", "category").persist()

    def units():
        for proto in protocols:
            for seed in seeds:
                if proto == "random":
                    rows = D.random_split(corpus, [seed], "row_id")
                else:
                    a = D.balanced_group_split(groups, [seed]) if proto == "group_disjoint" else D.stratified_group_split(groups, [seed])
                    rows = D.apply_split(corpus, a, "grp")
                yield Unit({"protocol": proto, "split_seed": seed}, rows.filter("side = 'train'"), {"test": rows.filter("side = 'test'")})
    return run_units(spark, units(), cols, specs, model_seeds, store)


def in_target_reference(spark: SparkSession, corpus: DataFrame, cols: list[str], specs, design: str, variant: str = "clean",
                        seeds: list[int] = (101,), n_train: int | None = None, last_station_file: int = 10, store: str | None = None) -> DataFrame:
    """M23. random, lofo (leave one file out) or station designs under a label variant."""
    pool = C.training_labels(corpus, variant)

    def cut(d: DataFrame, seed: int) -> DataFrame:
        return D.subsample(d, n_train, seed, "row_id") if n_train else d

    def units():
        if design == "random":
            for s in seeds:
                rows = D.random_split(cut(pool, s), [s], "row_id")
                yield Unit({"unit": f"seed{s}"}, rows.filter("side = 'train'"), {"test": rows.filter("side = 'test'")})
        elif design == "lofo":
            for r in corpus.select("file").distinct().orderBy("file").collect():          # one row per capture file
                f = r[0]
                yield Unit({"unit": f"file{f}"}, cut(pool.filter(F.col("file") != f), 100 + int(f)), {"test": corpus.filter(F.col("file") == f)}, plain=not n_train)
        elif design == "station":
            first = F.col("file") <= last_station_file
            for name, tr, te in (("s1_to_s2", first, ~first), ("s2_to_s1", ~first, first)):
                for s in seeds:
                    yield Unit({"unit": f"{name}__seed{s}"}, cut(pool.filter(tr), s), {"test": corpus.filter(te)}, plain=not n_train)
        else:
            raise ValueError(f"unknown design {design!r}")
    return run_units(spark, units(), cols, specs, store=store, keep=[*KEEP, "file", "is_copy"])


def published_run(spark: SparkSession, corpus: DataFrame, feature_sets: dict[str, list[str]], specs, repeats: int = 5, folds: int = 5,
                  file: str = "file", site: str = "site", neighbours: int | None = 5, store: str | None = None) -> DataFrame:
    """M10. A published pipeline, changed by one thing a rung: scores by (rung, feature_set, split, model).

    R0 is the published random 70/30 split on the first feature set, with the neighbour vote. R1
    is the same split on the second set, without the counters that give a row's position away.
    R2 keeps capture files whole: each file is tested once over the folds. R3 trains on one
    station's files and tests on the other's, both ways. R2 and R3 run on both sets. A side
    of one class is skipped. `neighbours` None leaves the vote out.
    """
    (first, second) = list(feature_sets)
    specs = tuple(specs)
    vote = (Neighbours(neighbours),) if neighbours else ()

    def unit(rung: str, name: str, split: str, train: DataFrame, test: DataFrame, more: tuple = ()) -> Unit:
        return Unit({"rung": rung, "feature_set": name, "split": split}, train, {"test": test}, cols=feature_sets[name], specs=specs + more)

    def units():
        for r in range(repeats):
            rows = D.random_split(corpus, [100 + r], "row_id", 0.3).drop("split_seed").persist()
            tr, te = (rows.filter(F.col("side") == x).drop("side") for x in ("train", "test"))
            yield unit("R0", first, f"rep{r}", tr, te, vote)
            yield unit("R1", second, f"rep{r}", tr, te)
        dealt = D.group_k_fold(D.group_summary(corpus, file), folds).select(F.col("grp").alias("_g"), "fold")
        rows = corpus.join(dealt, F.col(file).cast("string") == F.col("_g")).drop("_g").persist()
        for k in range(folds):
            for name in (first, second):
                yield unit("R2", name, f"fold{k}", rows.filter(F.col("fold") != k).drop("fold"), rows.filter(F.col("fold") == k).drop("fold"))
        for a, b in ((1, 2), (2, 1)):
            for name in (first, second):
                yield unit("R3", name, f"site{a}to{b}", corpus.filter(F.col(site) == a), corpus.filter(F.col(site) == b))

    return run_units(spark, units(), [], specs, store=store, keep=[*KEEP, file, "is_copy"])


def published_summary(scores: DataFrame) -> DataFrame:
    """M10. Per rung, set and model: means over splits on all test rows, and on those that are no copies of attacks (`clean_`)."""
    by = ["rung", "feature_set", "model"]
    s = scores.withColumn("pred", C.predict())
    names = ["accuracy", "balanced_accuracy", "recall", "fpr"]
    both = s.withColumn("_clean", F.lit(0)).unionByName(s.filter(~F.col("is_copy")).withColumn("_clean", F.lit(1)))
    m = C.detection_metrics(C.confusion(both, [*by, "split", "_clean"]))
    of = lambda c, v: F.avg(F.when(F.col("_clean") == v, F.col(c)))                          # noqa: E731
    return m.groupBy(*by).agg(F.count_if(F.col("_clean") == 0).alias("n_splits"), F.sum(F.when(F.col("_clean") == 0, sum(F.col(c) for c in C.CELLS))).alias("n_test"),
                              *[of(c, 0).alias(c) for c in names], *[of(c, 1).alias(f"clean_{c}") for c in names])


def third_corpus_run(spark: SparkSession, corpus: DataFrame, feature_sets: dict[str, list[str]], specs, seeds: list[int], file: str = "file",
                     store: str | None = None) -> DataFrame:
    """M23 on a corpus without an outside target: the ladder under a random split stratified by class, and leaving out one
    capture file after the other, on every feature set. Scores by (feature_set, protocol, split, model)."""
    def units():
        for name, cols in feature_sets.items():
            for s in seeds:
                rows = D.stratified_random_split(corpus, "row_id", s)
                yield Unit({"feature_set": name, "protocol": "random", "split": f"seed{s}"}, rows.filter("side = 'train'").drop("side"),
                           {"test": rows.filter("side = 'test'").drop("side")}, cols=cols)
            for r in corpus.select(file).distinct().orderBy(file).collect():                 # one row per capture file
                yield Unit({"feature_set": name, "protocol": "leave_one_file", "split": str(r[0])}, corpus.filter(F.col(file) != r[0]),
                           {"test": corpus.filter(F.col(file) == r[0])}, cols=cols, plain=True)
    return run_units(spark, units(), [], specs, store=store)


def feature_set_ceilings(corpus: DataFrame, feature_sets: dict[str, list[str]], y: str = "y") -> DataFrame:
    """A25 for several feature sets: what a lookup on distinct records, rounded to nine places, could reach at best."""
    parts = []
    for name, cols in feature_sets.items():
        d = corpus.select(y, *[F.round(S.dbl(c), 9).alias(c) for c in cols])
        r = A.conflict_ceiling(d, cols, y)
        parts.append(r.select(F.lit(name).alias("feature_set"), F.lit(len(cols)).alias("n_features"), "n_distinct", "flows_in_conflicting",
                              "share_in_conflicting", "attack_share_in_conflicting", "ba_ceiling"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def exporter_sensitivity(source: DataFrame, target: DataFrame, feature_sets: dict[str, list[str]], row_id: str = "row_id", folds: int = 5,
                         max_iter: int = 200, seed: int = 7) -> dict[str, DataFrame]:
    """How separable two corpora are, and in which features. The first feature set holds all features, the last the robust ones.

    `domain`: balanced accuracy of a domain classifier on each set, mean and sample sd over stratified folds.
    `features`: each feature's domain AUC, medians, and W1 after the source's quantile map, which is
    fitted on the source alone and applied to both. `summary`: the mean W1 of all, robust and other features.
    """
    names = list(feature_sets)
    cols, robust = feature_sets[names[0]], feature_sets[names[-1]]
    dom = reduce(lambda a, b: a.unionByName(b), [
        SH.domain_classifier(source, target, c, row_id, folds, max_iter, seed).agg(
            F.lit(n).alias("feature_set"), F.lit(len(c)).alias("n_features"), F.avg("balanced_accuracy").alias("balanced_accuracy"),
            F.stddev_samp("balanced_accuracy").alias("ba_sd")) for n, c in feature_sets.items()])
    f = _features(source, target, cols, robust)
    w1 = F.col("w1_source_quantile")
    return {"domain": dom, "features": f, "summary": f.agg(F.avg(w1).alias("w1_mean_shared"), F.avg(F.when(F.col("robust") == 1, w1)).alias("w1_mean_robust"),
                                                           F.avg(F.when(F.col("robust") == 0, w1)).alias("w1_mean_nonrobust"))}


def exporter_features(source: DataFrame, target: DataFrame, cols: list[str], robust: list[str]) -> DataFrame:
    """A36-A38 side by side: (feature, robust, domain_auc, w1_source_quantile, median_a, median_b).

    Each value of a feature is a row of counts, so features are taken a few at a time, one where the tables are large: the disk
    holds what one turn stored and shuffled, whatever their number.
    """
    most, parts = max(1, VALUES_AT_ONCE // max(1, source.count() + target.count())), []
    for i in range(0, len(cols), most):
        with O.released(), dropping_shuffles(source.sparkSession):
            parts.append(checkpoint(_features(source, target, cols[i:i + most], robust)))
    return reduce(DataFrame.unionByName, parts)


def _features(source: DataFrame, target: DataFrame, cols: list[str], robust: list[str]) -> DataFrame:
    grid = SH.quantile_map(source, cols)
    qa, qb = (SH.melt(SH.apply_quantile_map(d.select(*cols), grid), cols) for d in (source, target))
    w = SH.wasserstein1(qa, qb).withColumnRenamed("w1", "w1_source_quantile")
    return SH.univariate_domain_auc(source, target, cols).join(w, "feature").withColumn("robust", F.col("feature").isin(robust).cast("int"))


def label_efficient_run(spark: SparkSession, source: DataFrame, target: DataFrame, cols: list[str], specs, ks: list[int], draws: int,
                        variants=("source+k", "target-only"), n_sub: int | None = None, store: str | None = None) -> DataFrame:
    """M24. k labelled target files per draw, with or without the source."""
    picks = D.file_draw(target, ks, draws).persist()

    def units():
        for k in ks:
            for r in range(draws):
                mine = picks.filter((F.col("k") == k) & (F.col("draw") == r)).select("file", F.col("side").alias("_s"))
                t = target.join(mine, "file")
                tr, te = _source_split(source, 101 + r, n_sub)
                held = t.filter("_s = 'held_out'").drop("_s")
                relab = held.withColumn("y", F.when(F.col("is_copy"), 1).otherwise(F.col("y")))
                for v in variants:
                    pool = D.label_efficient_pool(tr, t.filter("_s = 'labelled'").drop("_s"), v, 20_000 * k + 100 * r, "row_id")
                    yield Unit({"k": k, "draw": r, "variant": v}, pool, {"source_heldout": te, "target_relab": relab, "target_clean": held.filter(~F.col("is_copy"))})
    return run_units(spark, units(), cols, specs, store=store)


def grouping_confound_run(spark: SparkSession, corpus: DataFrame, cols: list[str], specs, groupings: dict[str, str], seeds: list[int],
                          store: str | None = None) -> DataFrame:
    """M25. The ladder under several group columns and a random split."""
    def units():
        for seed in seeds:
            for name, g in groupings.items():
                rows = D.apply_split(corpus, D.balanced_group_split(D.group_summary(corpus, g), [seed]), g)
                yield Unit({"grouping": name, "split_seed": seed}, rows.filter("side = 'train'"), {"test": rows.filter("side = 'test'")})
            rows = D.random_split(corpus, [seed], "row_id")
            yield Unit({"grouping": "none", "split_seed": seed}, rows.filter("side = 'train'"), {"test": rows.filter("side = 'test'")})
    return run_units(spark, units(), cols, specs, store=store)


def drift_run(spark: SparkSession, windows: DataFrame, sessions: DataFrame, cols: list[str], specs, fracs: list[float], reps: int,
              store: str | None = None) -> DataFrame:
    """M26. Temporal splits against random session controls of the same size."""
    temporal = D.temporal_split(sessions, fracs).persist()
    control = D.random_session_control(sessions, fracs, reps).persist()

    def rows(a: DataFrame) -> Unit | DataFrame:
        return windows.join(a.select("session", "side"), "session")

    def units():
        for f in fracs:
            for direction in ("forward", "reverse"):
                r = rows(temporal.filter((F.col("train_frac") == f) & (F.col("direction") == direction)))
                yield Unit({"protocol": "temporal", "direction": direction, "train_frac": f, "rep": 0}, r.filter("side = 'train'"), {"test": r.filter("side = 'test'")})
            for rep in range(reps):
                r = rows(control.filter((F.col("train_frac") == f) & (F.col("rep") == rep)))
                yield Unit({"protocol": "random_sessions", "direction": "n/a", "train_frac": f, "rep": rep}, r.filter("side = 'train'"), {"test": r.filter("side = 'test'")})
    return run_units(spark, units(), cols, specs, store=store)


def benign_session_run(spark: SparkSession, windows: DataFrame, cols: list[str], specs, benign_sessions: list, store: str | None = None) -> DataFrame:
    """M26. FPR of each benign session when it is held out."""
    units = (Unit({"session": s}, windows.filter(F.col("session") != s), {"held_out": windows.filter(F.col("session") == s)}) for s in benign_sessions)
    return run_units(spark, units, cols, specs, store=store)


def alert_burden_run(scores: DataFrame, keys: list[str], cluster: str = "grp") -> DataFrame:
    """M27. Counts on the fine grid by cluster."""
    return C.counts_at(scores, C.TAU_FINE, [*keys, cluster])


def consolidate(scores: DataFrame, copied_domains: list[str], keys=("model", "split_seed", "domain"), cluster: str = "grp") -> dict[str, DataFrame]:
    """M28. Runs, counts, recalls and bins of every view from stored scores. Views of runs and bins are made of counted scores, not of rows."""
    v = C.views(scores, copied_domains)
    k = [*keys, "view"]
    counted = scores.groupBy(*dict.fromkeys([*keys, "domain", "is_copy", "y", "score"])).agg(F.count(F.lit(1)).alias("_n"))
    t = C.score_table(C.views(counted, copied_domains), k, freq="_n").persist()
    two = "view in ('all', 'clean')"
    return {"runs": runs_of(None, k, table=t), "counts": C.counts_at(v, C.TAU_FINE, [*k, cluster]),
            "recalls": C.per_category_recall(v.filter("view = 'all'"), list(keys)),
            "bins": C.reliability_bins(v.filter(two), k, ["row_id"], table=t.filter(two))}


def calibration_runs(spark: SparkSession, source: DataFrame, target: DataFrame, cols: list[str], specs, seeds: list[int],
                     kinds=("raw", "platt", "isotonic", "temperature")) -> DataFrame:
    """M15. Whole groups to train, calibration and test; every calibrator on both domains."""
    parts = []
    for seed in seeds:
        a = D.three_way_group_split(D.group_summary(source, "grp"), [seed])
        rows = D.apply_split(source, a, "grp").persist()
        for spec in specs:
            m = M.fit_model(spec, rows.filter("side = 'train'"), cols)
            cal = M.predict_scores(m, rows.filter("side = 'calibration'")).select("y", "score").persist()
            doms = {"source_test": rows.filter("side = 'test'"), "target": target}
            for kind in kinds:
                use = K.fit_calibrator(cal, kind)
                for name, d in doms.items():
                    s = use(M.predict_scores(m, d)).select(F.lit(seed).alias("seed"), F.lit(spec.key).alias("model"), F.lit(name).alias("domain"),
                                                           F.lit(kind).alias("calibrator"), "row_id", "y", F.col("calibrated").alias("score"))
                    parts.append(s)
    return reduce(lambda a, b: a.unionByName(b), parts)


def platt_diagnosis(spark: SparkSession, source: DataFrame, cols: list[str], spec, seeds: list[int]) -> DataFrame:
    """M29. Calibration and test AUC beside the Platt slope."""
    rows_out = []
    for seed in seeds:
        rows = D.apply_split(source, D.three_way_group_split(D.group_summary(source, "grp"), [seed]), "grp").persist()
        m = M.fit_model(spec, rows.filter("side = 'train'"), cols)
        s = M.predict_scores(m, rows.filter("side <> 'train'")).select("side", "y", "score").persist()
        auc = {r["side"]: r["roc_auc"] for r in C.rank_metrics(s, ["side"]).collect()}
        t = C.score_table(s.filter("side = 'calibration'"), [])
        fit = K.platt(t.select(K.clipped("score").alias("_s"), F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), S.dbl("pos").alias("w")), F.struct(F.lit(0.0).alias("label"), S.dbl("neg").alias("w")))).alias("x"))
            .select("_s", "x.label", "x.w").filter("w > 0"))
        rows_out.append((seed, spec.key, auc.get("calibration"), auc.get("test"), float(fit.coefficients[0])))
    d = spark.createDataFrame(rows_out, "seed int, model string, auc_calibration double, auc_test double, platt_slope double")
    return d.withColumn("inverted", (F.col("platt_slope") < 0).cast("int"))


def novelty_run(source_train: DataFrame, tests: dict[str, DataFrame], cols: list[str], seed: int = 11, n_trees: int = 200) -> DataFrame:
    """M19, M20. Detectors of benign rows only; the threshold is a quantile of their own scores."""
    benign = source_train.filter("y = 0").persist()
    forest = M.isolation_forest(benign, cols, "row_id", n_trees, seed=seed)
    names = list(tests)
    scored = {"iforest": [M.isolation_scores(d, cols, forest) for d in (benign, *tests.values())],
              "reconstruction": M.reconstruction_scores(benign, [benign, *tests.values()], cols)}
    parts = []
    for key, (b, *rest) in scored.items():
        thr = M.novelty_threshold(b)
        parts += [d.select(F.lit(key).alias("model"), F.lit(n).alias("domain"), "row_id", "y", "category", "score", F.lit(thr).alias("threshold"))
                  for n, d in zip(names, rest)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def robustness_run(train: DataFrame, test: DataFrame, cols: list[str], specs, seed: int, order: list[str], attacks=R.ATTACKS, eps=R.EPS_GRID) -> DataFrame:
    """R8. Deltas of each attack and strength against the unperturbed test table."""
    hit = [c for c in cols if not c.startswith("proto_")]
    scale = R.column_scale(test, hit)
    parts = []
    for spec in specs:
        m = M.fit_model(spec, train, cols)
        for name in attacks:
            for e in eps:
                z = R.attack(test, name, e, seed, "row_id", hit, scale, order)
                parts.append(M.predict_scores(m, z).select(F.lit(spec.key).alias("model"), F.lit(name).alias("attack"), F.lit(e).alias("eps"), "y", "score"))
    s = reduce(lambda a, b: a.unionByName(b), parts)
    return R.robustness_deltas(runs_of(s, ["model", "attack", "eps"], ranks=False), ["model", "attack"])


def poisoning_run(train: DataFrame, test: DataFrame, cols: list[str], specs, seed: int, rates=R.POISON_GRID) -> DataFrame:
    """R7. Refits on flipped training labels."""
    parts = []
    for spec in specs:
        for r in rates:
            d = R.poison_labels(train.select("row_id", "y", *cols), r, f"poison{seed}", "row_id").persist()      # freed after its fit
            m = M.fit_model(spec, d, cols)
            d.unpersist()
            parts.append(M.predict_scores(m, test).select(F.lit(spec.key).alias("model"), F.lit(r).alias("eps"), "y", "score"))
    s = reduce(lambda a, b: a.unionByName(b), parts)
    return R.robustness_deltas(runs_of(s, ["model", "eps"], ranks=False), ["model"])


def _coral_like(train: DataFrame, test: DataFrame, target: DataFrame, cols: list[str]) -> DataFrame:
    """The held-out source fold under the map fitted on the training rows."""
    both = train.withColumn("_te", F.lit(0)).unionByName(test.withColumn("_te", F.lit(1)), allowMissingColumns=True)
    return SH.coral(both, target, cols, fit=F.col("_te") == 0)[0].filter("_te = 1").drop("_te")
