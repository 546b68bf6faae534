"""Queries over runs: intervals, tests, bootstraps, frontier, latency, calibration, neighbours."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S
from ..functions import statdist as D
from ..operators import burden as B
from ..operators import calibrate as K
from ..operators import counts as C
from ..operators import flows as FL
from ..operators import inference as I
from ..operators import joins as J
from ..operators import latency as L
from ..operators import splits as SPL
from . import bindings as X
from . import telemetry as T
from .detection import COUNTS, KS, NB, RATIO, T3, _counts, _pooled
from .registry import LI, SCORES, ba_sql, counts_sql, h, ppv_sql, query, r6, u

KEYS = ["model", "split_seed", "domain"]

# ------------------------------------------------------------------- runs
_F1 = "(coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0) + coalesce(2e0 * tn / nullif(2e0 * tn + fp + fn, 0), 0)) / 2"
RUNS = f"""{SCORES}, ext AS (SELECT {KS}, y, score FROM scores UNION ALL SELECT 'majority', split_seed, "domain", y, 0e0 FROM scores WHERE model = 'net'
  UNION ALL SELECT 'stratified', split_seed, "domain", y, {u("'st' || row_id")} FROM scores WHERE model = 'net'),
cf AS (SELECT {KS}, count(*) AS n_eval, count(*) FILTER (WHERE y = 1 AND score >= 0.5e0) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5e0) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5e0) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5e0) AS tn FROM ext GROUP BY {KS}),
runs AS (SELECT *, {_F1} AS f1_macro, {ba_sql()} AS balanced_accuracy, fp / nullif(fp + tn, 0)::DOUBLE AS fpr FROM cf)"""


def _runs(spark, d):
    """The counts are read off one pass and kept: a row for each model, split and domain."""
    s = X.scores(spark, d, {"_st": S.hash_unit(F.concat(F.lit("st"), F.col("row_id")))}).select(*KEYS, "y", "score", "_st")
    as_ = lambda model, score: F.struct(model.alias("model"), score.alias("score"))              # noqa: E731
    own = as_(F.col("model"), F.col("score"))
    all_ = F.when(F.col("model") == "net", F.array(own, as_(F.lit("majority"), F.lit(0.0)), as_(F.lit("stratified"), F.col("_st")))).otherwise(F.array(own))
    m = s.select("split_seed", "domain", "y", F.explode(all_).alias("_m")).select(F.col("_m.model").alias("model"), "split_seed", "domain", "y",
                                                                                  C.predict(F.col("_m.score")).alias("pred"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return C.detection_metrics(O.cached(C.confusion(m, KEYS))).withColumn("n_eval", n)


def _iv(v: str, keys: str, src: str, ratio: str = NB) -> str:
    """Mean, plain t and corrected interval of v per key, for four splits."""
    return f"""SELECT {keys}, n, round(m, 6) AS mean, round(CASE WHEN n >= 2 AND sd > 0 THEN m - {T3} * sd / sqrt(n) ELSE m END, 6) AS t_lo, round(CASE WHEN n >= 2 AND sd > 0 THEN m + {T3} * sd / sqrt(n) ELSE m END, 6) AS t_hi,
  round(CASE WHEN n >= 2 AND sd > 0 THEN m - {T3} * sd * {ratio} ELSE m END, 6) AS nb_lo, round(CASE WHEN n >= 2 AND sd > 0 THEN m + {T3} * sd * {ratio} ELSE m END, 6) AS nb_hi, round(CASE WHEN sd > 0 THEN m / sd END, 6) AS d_z
FROM (SELECT {keys}, count({v}) AS n, avg({v}) AS m, stddev_samp({v}) AS sd FROM {src} GROUP BY {keys})"""


IV = ["n", "mean", "t_lo", "t_hi", "nb_lo", "nb_hi", "d_z"]
DIFF = RUNS + """, df AS (SELECT s.model, s.split_seed, s.balanced_accuracy - t.balanced_accuracy AS d, s.balanced_accuracy AS s_ba, t.balanced_accuracy AS t_ba, s.f1_macro AS s_f1, t.f1_macro AS t_f1
  FROM runs s JOIN runs t USING (model, split_seed) WHERE s."domain" = 'source_heldout' AND t."domain" = 'target')"""


def _diff(spark, d):
    r = _runs(spark, d).select(*KEYS, "balanced_accuracy", "f1_macro")
    return I.paired(r.filter("domain = 'source_heldout'").drop("domain"), r.filter("domain = 'target'").drop("domain"), ["model", "split_seed"], ("_s", "_t"))


@query("paired_intervals", f"WITH {DIFF} {_iv('d', 'model', 'df')}")
def paired_intervals(spark, d):
    """I1, I2, J1."""
    r = I.paired_interval(_diff(spark, d), ["model"], F.col("balanced_accuracy_s") - F.col("balanced_accuracy_t"), RATIO, p_values=False)
    return r6(r.select("model", *IV))


@query("paired_p_values", None)
def paired_p_values(spark, d):
    """I1, I2 with p-values, corrected by Holm: the t distribution has no SQL twin."""
    r = I.paired_interval(_diff(spark, d), ["model"], F.col("balanced_accuracy_s") - F.col("balanced_accuracy_t"), RATIO)
    return r6(I.holm(r.withColumn("family", F.lit("all")), ["family"], "p_nb"))


@query("transfer_summary", f"""WITH {DIFF}, b AS (SELECT split_seed, max(CASE WHEN model = 'majority' THEN s_f1 - t_f1 END) AS mj, max(CASE WHEN model = 'stratified' THEN t_f1 END) AS st FROM df GROUP BY split_seed),
l AS (SELECT model, split_seed, unnest(['d_f1_macro', 'd_balanced_accuracy', 'did', 'vs_floor', 'ba_vs_chance']) AS measure, unnest([s_f1 - t_f1, d, s_f1 - t_f1 - mj, t_f1 - st, t_ba - 0.5e0]) AS v FROM df JOIN b USING (split_seed)) {_iv('v', 'model, measure', 'l')}""")
def transfer_summary(spark, d):
    """I16, J19."""
    r = I.transfer_summary(_runs(spark, d), [], RATIO, "source_heldout", "target", metrics=("f1_macro", "balanced_accuracy"), p_values=False)
    return r6(r.select("model", "measure", *IV))


PROT = f"""{SCORES}, pr AS (SELECT unnest(['random', 'group_disjoint', 'stratified_group']) AS protocol),
pk AS (SELECT protocol, model, split_seed, y, score FROM scores, pr WHERE {u("CASE protocol WHEN 'random' THEN 'pr' || split_seed || '|' || row_id WHEN 'group_disjoint' THEN 'pg' || split_seed || '|' || grp ELSE 'ps' || split_seed || '|' || grp || '|' || category END")} < 0.2e0),
pc AS (SELECT protocol, model, split_seed, count(*) FILTER (WHERE y = 1 AND score >= 0.5e0) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5e0) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5e0) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5e0) AS tn FROM pk GROUP BY ALL),
pf AS (SELECT protocol, model, split_seed, {_F1} AS f1_macro FROM pc)"""


def _protocols(spark, d):
    kind = {"random": ("pr", ["row_id"]), "group_disjoint": ("pg", ["grp"]), "stratified_group": ("ps", ["grp", "category"])}
    hit = F.array_compact(F.array(*[F.when(S.hash_unit(F.concat(F.lit(t), F.col("split_seed").cast("string")), *cols) < 0.2, F.lit(p))
                                    for p, (t, cols) in kind.items()]))
    s = X.scores(spark, d, {"_hit": hit}).withColumn("protocol", F.explode("_hit")).withColumn("pred", C.predict())
    return C.detection_metrics(O.cached(C.confusion(s, ["protocol", "model", "split_seed"]))).select("protocol", "model", "split_seed", "f1_macro")


@query("protocol_gain", f"""WITH {PROT}, w AS (SELECT model, split_seed, max(f1_macro) FILTER (WHERE protocol = 'random') AS r, max(f1_macro) FILTER (WHERE protocol = 'group_disjoint') AS g, max(f1_macro) FILTER (WHERE protocol = 'stratified_group') AS s FROM pf GROUP BY ALL),
l AS (SELECT model, split_seed, unnest(['random-group_disjoint', 'random-stratified_group', 'stratified_group-group_disjoint']) AS comparison, unnest([r - g, r - s, s - g]) AS v FROM w), al AS (SELECT * FROM l UNION ALL SELECT 'average', split_seed, comparison, avg(v) FROM l GROUP BY split_seed, comparison)
{_iv('v', 'comparison, model', 'al')}""")
def protocol_gain(spark, d):
    """I17."""
    return r6(I.protocol_gain(_protocols(spark, d), [], "f1_macro", RATIO, p_values=False).select("comparison", "model", *IV))


@query("harmonisation_loss", f"""WITH {DIFF}, l AS (SELECT model, split_seed, unnest(['f1_macro', 'balanced_accuracy']) AS metric, unnest([s_f1, s_ba]) AS f, unnest([t_f1, t_ba]) AS s FROM df), i AS (SELECT *, f - s AS v FROM l), a AS ({_iv('v', 'model, metric', 'i')}), b AS (SELECT model, metric, round(avg(f), 6) AS "full", round(avg(s), 6) AS shared FROM l GROUP BY ALL)
SELECT * FROM a JOIN b USING (model, metric)""")
def harmonisation_loss(spark, d):
    """The held-out source stands for the full space and the target for the shared one."""
    r = _runs(spark, d)
    return r6(I.harmonisation_loss(r.filter("domain = 'source_heldout'"), r.filter("domain = 'target'"), ["f1_macro", "balanced_accuracy"], RATIO)
              .select("model", "metric", "full", "shared", *IV))


@query("exporter_contrast", f"""WITH {DIFF}, i AS (SELECT model, split_seed, t_ba - s_ba AS v, s_ba, t_ba FROM df), a AS ({_iv('v', 'model', 'i')}), b AS (SELECT model, round(avg(s_ba), 6) AS ba_a, round(avg(t_ba), 6) AS ba_b FROM i GROUP BY model)
SELECT model, ba_a, ba_b, n, mean, t_lo, t_hi, (t_lo > 0)::INT AS sig_pos, (t_hi < 0)::INT AS sig_neg FROM a JOIN b USING (model)""")
def exporter_contrast(spark, d):
    """I19."""
    r = _runs(spark, d).withColumnRenamed("balanced_accuracy", "ba").select(*KEYS, "ba")
    e = I.exporter_contrast(r.filter("domain = 'source_heldout'").drop("domain"), r.filter("domain = 'target'").drop("domain"), ["model"])
    return r6(e.select("model", "ba_a", "ba_b", "n", "mean", "t_lo", "t_hi", "sig_pos", "sig_neg"))


@query("reference_gap", f"""WITH {COUNTS}, c AS (SELECT * FROM counts WHERE abs(tau - 0.5e0) < 1e-9), rf AS (SELECT model, 0.5e0 * (sum(tp) / sum(tp + fn)::DOUBLE + sum(tn) / sum(tn + fp)::DOUBLE) AS ref_ba FROM c WHERE "domain" = 'source_heldout' GROUP BY model),
i AS (SELECT model, split_seed, ref_ba, {ba_sql()} AS ba, ref_ba - {ba_sql()} AS v FROM c JOIN rf USING (model) WHERE "domain" = 'target'), a AS ({_iv('v', 'model', 'i')}), b AS (SELECT model, round(max(ref_ba), 6) AS ref_ba, round(avg(ba), 6) AS transfer_ba FROM i GROUP BY model)
SELECT * FROM a JOIN b USING (model)""")
def reference_gap(spark, d):
    """I20."""
    c = _counts(spark, d).filter(S.same_tau("tau", 0.5))
    return r6(I.reference_gap(c.filter("domain = 'source_heldout'"), c.filter("domain = 'target'"), ["model"], RATIO).select("model", "ref_ba", "transfer_ba", *IV))


@query("sample_size_curve", f"""WITH {SCORES}, e AS (SELECT model, split_seed, n, y, score FROM scores, (SELECT unnest([1, 2, 3]) AS n) WHERE "domain" = 'target' AND {u("'sz' || row_id")} < n / 3e0),
c AS (SELECT model, split_seed, n, count(*) FILTER (WHERE y = 1 AND score >= 0.5e0) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5e0) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5e0) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5e0) AS tn FROM e GROUP BY ALL),
g AS (SELECT n, model, avg({ba_sql()}) AS mean, count(DISTINCT split_seed) AS splits FROM c GROUP BY n, model)
SELECT g.n, g.model, round(g.mean, 6) AS mean, g.splits, round(abs(g.mean - r.mean), 6) AS abs_change FROM g LEFT JOIN g r ON r.model = g.model AND r.n = 2""")
def sample_size_curve(spark, d):
    """I21, J20."""
    s = X.scores(spark, d).filter("domain = 'target'").withColumn("_u", S.hash_unit(F.concat(F.lit("sz"), F.col("row_id"))))
    s = s.withColumn("n", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).filter(F.col("_u") < F.col("n") / 3.0).withColumn("pred", C.predict())
    r = C.detection_metrics(C.confusion(s, ["n", "model", "split_seed"]))
    return r6(I.sample_size_curve(r, 2, keys=("model",)))


@query("in_target_summary", f"""WITH {RUNS} SELECT 'shared' AS feature_set, "domain" AS protocol, model, count(*) AS n, round(avg(balanced_accuracy), 6) AS ba, round(min(balanced_accuracy), 6) AS ba_min, round(max(balanced_accuracy), 6) AS ba_max, round(avg(fpr), 6) AS fpr FROM runs GROUP BY "domain", model""")
def in_target_summary(spark, d):
    """I24."""
    r = _runs(spark, d).withColumn("feature_set", F.lit("shared")).withColumnRenamed("domain", "protocol")
    return r6(I.in_target_summary(r))


@query("group_ratio", f"""WITH {LI}, sd AS (SELECT unnest([101, 102, 103, 104]) AS split_seed), g AS (SELECT split_seed, grp, count(*) AS n, {u("'held' || split_seed || '|' || grp")} < 0.2e0 AS test FROM li, sd GROUP BY ALL),
s AS (SELECT split_seed, count(*) FILTER (WHERE test) AS gt, count(*) FILTER (WHERE NOT test) AS gr, sum(n) FILTER (WHERE test) AS nt, sum(n) FILTER (WHERE NOT test) AS nr FROM g GROUP BY split_seed) SELECT round(sum(gt) / sum(gr)::DOUBLE, 6) AS ratio_groups, round(avg(nt / nr::DOUBLE), 6) AS ratio_rows FROM s""")
def group_ratio(spark, d):
    """I3."""
    li = SPL._seeds(X.lineitem(spark, d).select("grp", "y"), X.SEEDS)
    st = SPL.split_stats(li.withColumn("side", SPL.side(S.hash_unit(F.concat(F.lit("held"), F.col("split_seed").cast("string")), "grp") < 0.2)))
    return r6(I.group_ratio(st).withColumn("ratio_rows", I.row_ratio(st).scalar()))


@query("holm", f"""WITH s AS (SELECT s_nationkey AS fam, s_suppkey AS id, CASE WHEN s_suppkey % 13 <> 0 THEN {u("'p' || s_suppkey")} / 10 END AS p FROM supplier), r AS (SELECT *, row_number() OVER w AS i, count(p) OVER (PARTITION BY fam) AS m FROM s WINDOW w AS (PARTITION BY fam ORDER BY p NULLS LAST)),
a AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1e0, max((m - i + 1) * p) OVER (PARTITION BY fam ORDER BY p NULLS LAST ROWS UNBOUNDED PRECEDING)) END AS ph FROM r) SELECT fam, id, round(p, 6) AS p, round(ph, 6) AS p_holm FROM a""")
def holm(spark, d):
    """W16."""
    s = X.table(spark, d, "supplier")
    p = F.when(F.pmod("s_suppkey", F.lit(13)) != 0, S.hash_unit(F.concat(F.lit("p"), F.col("s_suppkey").cast("string"))) / 10)
    return r6(I.holm(s.select(F.col("s_nationkey").alias("fam"), F.col("s_suppkey").alias("id"), p.alias("p")), ["fam"], "p"))


@query("paired_tests", """WITH x AS (SELECT o_orderstatus AS k, o_custkey AS split, avg(o_totalprice) AS a FROM orders GROUP BY ALL), y AS (SELECT c_custkey AS split, 250000 + c_acctbal AS b FROM customer), p AS (SELECT k, split, a - b AS d FROM x JOIN y USING (split)), r AS (SELECT k, d, rank() OVER w + (count(*) OVER (PARTITION BY k, round(abs(d), 12)) - 1) / 2e0 AS r FROM p WHERE d <> 0 WINDOW w AS (PARTITION BY k ORDER BY round(abs(d), 12))),
w AS (SELECT k, sum(r) FILTER (WHERE d > 0) AS wp, count(*)::DOUBLE AS n FROM r GROUP BY k), g AS (SELECT k, count(*) AS n, avg(d) AS mean FROM p GROUP BY k)
SELECT g.k, g.n, round(mean, 4) AS mean, round(wp, 4) AS w_plus, round((wp - w.n * (w.n + 1) / 4) / sqrt(w.n * (w.n + 1) * (2 * w.n + 1) / 24), 5) AS wilcoxon_z FROM g JOIN w USING (k)""")
def paired_tests(spark, d):
    """I4: mean order value of each customer and status against a level set by the balance."""
    o = X.table(spark, d, "orders").select(F.col("o_orderstatus").alias("k"), F.col("o_custkey").alias("split"), F.col("o_totalprice").alias("a"))
    c = X.table(spark, d, "customer").select(F.col("c_custkey").alias("split"), (F.col("c_acctbal") + 250000).alias("b"))
    r = I.paired_tests(o.join(c, "split"), ["k"], "split", "a", "b")
    return r.select("k", "n", F.round("mean", 4).alias("mean"), F.round("w_plus", 4).alias("w_plus"), F.round("wilcoxon_z", 5).alias("wilcoxon_z"))


@query("min_detectable_effect", f"SELECT s_nationkey AS k, round({repr(D.norm_ppf(0.975) + D.norm_ppf(0.8))}e0 / sqrt(count(*)), 6) AS mde FROM supplier GROUP BY 1")
def min_detectable_effect(spark, d):
    """I5."""
    n = X.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return r6(n.select("k", I.min_detectable_effect("n").alias("mde")))


def _draws(seed: str, src: str, key: str, unit: str, n: int, out: str) -> str:
    return f"""{out}p AS (SELECT {key}, {unit}, row_number() OVER (PARTITION BY {key} ORDER BY {h(unit + '::VARCHAR')}, {unit}) AS pl, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT DISTINCT {key}, {unit} FROM {src})),
{out}d AS (SELECT {key}, rep, (floor({u(f"'{seed}|' || {key} || '|' || rep || '|' || pl")} * n) + 1)::INT AS pl, count(*) AS w FROM {out}p, (SELECT unnest(range(1, {n + 1})) AS rep) GROUP BY ALL),
{out} AS (SELECT {key}, rep, {unit}, w FROM {out}d JOIN {out}p USING ({key}, pl))"""


@query("bootstrap_mean", f"""WITH v AS (SELECT s_nationkey AS k, s_suppkey AS id, s_acctbal AS v FROM supplier), {_draws('boot', 'v', 'k', 'id', 10000, 'w')}, b AS (SELECT k, rep, sum(w * v) / sum(w) AS x FROM w JOIN v USING (k, id) GROUP BY k, rep),
m AS (SELECT k, avg(v) AS mean, count(*) AS n FROM v GROUP BY k) SELECT k, round(max(mean), 4) AS mean, max(n) AS n, round(quantile_cont(x, 0.025), 4) AS boot_lo, round(quantile_cont(x, 0.975), 4) AS boot_hi, count(*) AS n_boot, (max(n) < 30)::INT AS few FROM m JOIN b USING (k) GROUP BY k""")
def bootstrap_mean(spark, d):
    """I7."""
    s = X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"))
    r = I.bootstrap_mean(s, ["k"], "v", "id")
    return r.select("k", "n", "n_boot", "few", *[F.round(c, 4).alias(c) for c in ("mean", "boot_lo", "boot_hi")])


@query("bootstrap_mean_values")
def bootstrap_mean_values(spark, d):
    """I7 over all line items: quantities have few distinct values, prices many. Draws by numpy have no SQL twin."""
    li = X.table(spark, d, "lineitem").select("l_linestatus", F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity").cast("double"), F.lit("price"), F.col("l_extendedprice").cast("double"))).alias("measure", "v"))
    r = I.bootstrap_mean_values(li, ["l_linestatus", "measure"], "v", 2000)
    return r.select("l_linestatus", "measure", "n", "n_boot", "few", *[F.round(c, 4).alias(c) for c in ("mean", "boot_lo", "boot_hi")])


CLUSTER = SCORES + ", " + counts_sql('model, split_seed, "file"', "(SELECT * FROM scores WHERE \"domain\" = 'target')", name="cc")


def _cluster_counts(spark, d):
    return C.counts_at(X.scores(spark, d).filter("domain = 'target'"), C.TAU_GRID, ["model", "split_seed", "file"])


@query("cluster_bootstrap", f"""WITH {CLUSTER}, {_draws('7c', 'cc', 'model', '"file"', 2000, 'wc')}, {_draws('7s', 'cc', 'model', 'split_seed', 2000, 'ws')},
r AS (SELECT model, rep, tau, sum(wc.w * ws.w * tp) AS tp, sum(wc.w * ws.w * fp) AS fp, sum(wc.w * ws.w * fn) AS fn, sum(wc.w * ws.w * tn) AS tn FROM cc JOIN wc USING (model, "file") JOIN ws USING (model, rep, split_seed) GROUP BY model, rep, tau),
q AS (SELECT model, rep, tau, tp / greatest(tp + fn, 1)::DOUBLE AS tpr, fp / greatest(fp + tn, 1)::DOUBLE AS fpr FROM r), v AS (SELECT *, {ppv_sql('tpr', 'fpr')} AS ppv FROM q),
s AS (SELECT model, rep, max(tpr) FILTER (WHERE abs(tau - 0.5e0) < 1e-9) AS tpr, max(fpr) FILTER (WHERE abs(tau - 0.5e0) < 1e-9) AS fpr, max(ppv) FILTER (WHERE abs(tau - 0.5e0) < 1e-9) AS ppv, max(ppv) FILTER (WHERE tpr >= 0.1e0) AS best_ppv FROM v GROUP BY model, rep)
SELECT model, {', '.join(f'round(quantile_cont({c}, 0.025), 6) AS {c}_lo, round(quantile_cont({c}, 0.975), 6) AS {c}_hi' for c in ('tpr', 'fpr', 'ppv', 'best_ppv'))}, count(*) AS n_boot FROM s GROUP BY model""")
def cluster_bootstrap(spark, d):
    """I8."""
    return r6(I.cluster_bootstrap(_cluster_counts(spark, d), ["model"], "file", "split_seed", 2000, "7"))


@query("delta_ba_bootstrap")
def delta_ba_bootstrap(spark, d):
    """A bias-corrected interval; the normal distribution has no SQL twin."""
    s = C.counts_at(X.scores(spark, d).filter("domain = 'source_heldout'"), [0.5], ["model", "split_seed", "file"])
    t = C.counts_at(X.scores(spark, d).filter("domain = 'target'"), [0.5], ["model", "split_seed", "file"])
    return r6(I.delta_ba_bootstrap(s, t, ["model"], "file"))


@query("mean_ba_bootstrap")
def mean_ba_bootstrap(spark, d):
    """I11."""
    t = C.counts_at(X.scores(spark, d).filter("domain = 'target'"), [0.5], ["model", "split_seed", "file"])
    return r6(I.mean_ba_bootstrap(t, ["model"], "file"))


@query("paired_reference_bootstrap")
def paired_reference_bootstrap(spark, d):
    """The held-out source files as the reference of the same files of the target."""
    k = ["model", "split_seed", "file"]
    s = C.counts_at(X.scores(spark, d).filter("domain = 'source_heldout'"), [0.5], k).groupBy("model", "file").agg(*[F.sum(c).alias(c) for c in C.CELLS])
    t = C.counts_at(X.scores(spark, d).filter("domain = 'target'"), [0.5], k)
    return r6(I.paired_reference_bootstrap(s, t, ["model"], "file"))


@query("pooled_bootstrap")
def pooled_bootstrap(spark, d):
    """I13."""
    t = C.counts_at(X.scores(spark, d).filter("domain = 'target'"), [0.5], ["model", "split_seed", "file"])
    return r6(I.pooled_bootstrap(t, ["model"], "file"))


# ---------------------------------------------------- drift and positions
DRIFT = f"""{T.TEMP}, rc AS (SELECT session, train_frac, rep, CASE WHEN row_number() OVER (PARTITION BY train_frac, rep ORDER BY {h("'rc|' || rep || '|' || session")}, session) <= round_even(train_frac * n, 0) THEN 'train' ELSE 'test' END AS side FROM tl, ns, (SELECT unnest([0.4e0, 0.5e0, 0.6e0, 0.7e0]) AS train_frac), (SELECT unnest(range(20)) AS rep)),
sy AS (SELECT session, sum(y) AS y, count(*) AS n FROM s GROUP BY session), tv AS (SELECT train_frac, direction, sum(y) / sum(n)::DOUBLE AS v FROM sp JOIN sy USING (session) WHERE side = 'test' GROUP BY ALL), cv AS (SELECT train_frac, rep, sum(y) / sum(n)::DOUBLE AS v FROM rc JOIN sy USING (session) WHERE side = 'test' GROUP BY ALL),
g AS (SELECT train_frac, direction, tv.v AS temporal, count(*) AS n_control, avg(cv.v) AS control_mean, stddev_samp(cv.v) AS control_sd, min(cv.v) AS lo, max(cv.v) AS hi, avg((cv.v < tv.v)::INT) AS pct, count(*) FILTER (WHERE cv.v <= tv.v) AS le FROM tv JOIN cv USING (train_frac) GROUP BY ALL),
pos AS (SELECT *, temporal - control_mean AS delta, CASE WHEN control_sd > 0 THEN (temporal - control_mean) / control_sd END AS z, (temporal < lo OR temporal > hi)::INT AS outside FROM g)"""


def _positions(spark, d):
    tl = T._timeline(spark, d)
    sy = T._sessions(spark, d).groupBy("session").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    share = lambda x, k: x.filter("side = 'test'").join(sy, "session").groupBy(*k).agg((F.sum("y") / F.sum("n")).alias("v"))     # noqa: E731
    fr = [0.4, 0.5, 0.6, 0.7]
    t = share(SPL.temporal_split(tl, fr), ["train_frac", "direction"]).withColumn("temporal", F.lit(True))
    c = share(SPL.random_session_control(tl, fr, 20), ["train_frac", "rep"]).withColumn("direction", F.explode(F.array(F.lit("forward"), F.lit("reverse"))))
    u_ = t.unionByName(c.drop("rep").withColumn("temporal", F.lit(False)))
    return I.control_position(u_.withColumnRenamed("temporal", "is_temporal"), ["train_frac", "direction"], "v", "is_temporal")


@query("control_position", f"""WITH {DRIFT} SELECT train_frac, direction, round(temporal, 6) AS temporal, n_control, round(control_mean, 6) AS control_mean, round(control_sd, 6) AS control_sd, round(lo, 6) AS control_min, round(hi, 6) AS control_max, round(pct, 6) AS percentile_in_control,
  round(delta, 6) AS delta, round(z, 6) AS z, outside AS outside_control_range, round((1e0 + le) / (1e0 + n_control), 6) AS p_low FROM pos""")
def control_position(spark, d):
    """I15."""
    return r6(_positions(spark, d))


@query("drift_summary", f"WITH {DRIFT} SELECT direction, round(avg(delta), 6) AS mean_delta, round(avg(z), 6) AS mean_z, sum(outside)::BIGINT AS n_outside, count(*) AS n FROM pos GROUP BY direction")
def drift_summary(spark, d):
    """I22."""
    return r6(I.drift_summary(_positions(spark, d), ["direction"]))


@query("held_out_fpr", f"""WITH {SCORES}, f AS (SELECT model, grp, avg((score >= 0.5e0)::INT) AS fpr FROM scores WHERE y = 0 AND "domain" = 'target' GROUP BY ALL) SELECT grp, round(avg(fpr), 6) AS fpr_mean, round(min(fpr), 6) AS fpr_min, round(max(fpr), 6) AS fpr_max, round(avg(fpr) * 225e0, 6) AS false_alerts_per_benign_ue_hour FROM f GROUP BY grp""")
def held_out_fpr(spark, d):
    """I22, O19."""
    s = X.scores(spark, d).filter("y = 0 AND domain = 'target'")
    return r6(I.held_out_fpr(s.groupBy("model", "grp").agg(F.avg(C.predict()).alias("fpr")), "grp"))


CUST = """cu AS (SELECT c_custkey AS id, c_nationkey AS k, c_acctbal AS bal, coalesce(n, 0) AS n_orders, coalesce(p, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(floor(o_totalprice * 100 + 0.5e0)::BIGINT) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


def _customers(spark, d):
    o = X.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")).alias("p"))
    c = X.table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"), F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("p", F.lit(0)).alias("total"))


@query("kendall_tau", f"""WITH {CUST}, p AS (SELECT a.k, sum((sign(a.bal - b.bal) * sign(a.n_orders - b.n_orders) > 0)::INT) AS con, sum((sign(a.bal - b.bal) * sign(a.n_orders - b.n_orders) < 0)::INT) AS dis, count(*) AS n0, sum((a.bal = b.bal)::INT) AS tx, sum((a.n_orders = b.n_orders)::INT) AS ty FROM cu a JOIN cu b ON a.k = b.k AND a.id < b.id GROUP BY a.k), n AS (SELECT k, count(*) AS n FROM cu GROUP BY k)
SELECT k, n, con::BIGINT AS con, dis::BIGINT AS dis, round((con - dis) / nullif(sqrt((n0 - tx)::DOUBLE) * sqrt((n0 - ty)::DOUBLE), 0), 6) AS kendall_tau FROM p JOIN n USING (k)""")
def kendall_tau(spark, d):
    """Exact tau-b without pairs, checked against all pairs."""
    return r6(I.kendall_tau(_customers(spark, d), ["k"], "bal", "n_orders"))


@query("rank_stability", f"""WITH {COUNTS}, pl AS (SELECT model, "domain", sum(tp) / sum(tp + fn)::DOUBLE AS tpr, sum(fp) / sum(fp + tn)::DOUBLE AS fpr FROM counts WHERE abs(tau - 0.5e0) < 1e-9 GROUP BY ALL), g AS (SELECT model, "domain", pi, {ppv_sql('tpr', 'fpr', 'pi')} AS v, {ppv_sql('tpr', 'fpr')} AS v0 FROM pl, (SELECT unnest([1e-4, 5e-4, 1e-3, 2e-3, 5e-3, 1e-2, 5e-2, 0.1e0, 0.2e0, 0.5e0]) AS pi)),
p AS (SELECT a."domain", a.pi, sum(sign(a.v - b.v) * sign(a.v0 - b.v0)) AS s, count(*) AS n0, sum((a.v = b.v)::INT) AS tx, sum((a.v0 = b.v0)::INT) AS ty FROM g a JOIN g b ON a."domain" = b."domain" AND a.pi = b.pi AND a.model < b.model GROUP BY ALL),
bm AS (SELECT "domain", pi, arg_max(model, (v, model)) AS best_model FROM g GROUP BY ALL) SELECT "domain", pi, best_model, round(s / nullif(sqrt((n0 - tx)::DOUBLE) * sqrt((n0 - ty)::DOUBLE), 0), 6) AS kendall_tau FROM p JOIN bm USING ("domain", pi)""")
def rank_stability(spark, d):
    """A34, T5."""
    g = B.cross_grid(_pooled(spark, d).filter(S.same_tau("tau", 0.5)), pi=B.PI_SWEEP)
    g = g.withColumn("v", S.ppv("tpr", "fpr", F.col("pi"))).withColumn("v0", S.ppv("tpr", "fpr"))
    best = g.groupBy("domain", "pi").agg(F.max(F.struct("v", "model")).getField("model").alias("best_model"))
    return r6(best.join(I.kendall_tau(g, ["domain", "pi"], "v", "v0").select("domain", "pi", "kendall_tau"), ["domain", "pi"]))


@query("rank_correlation", f"""WITH {CUST}, r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY bal) + (count(*) OVER (PARTITION BY k, bal) - 1) / 2e0 AS a, rank() OVER (PARTITION BY k ORDER BY n_orders) + (count(*) OVER (PARTITION BY k, n_orders) - 1) / 2e0 AS b FROM cu)
SELECT k, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY k""")
def rank_correlation(spark, d):
    """A33."""
    return r6(I.rank_correlation(_customers(spark, d), ["k"], "bal", "n_orders"))


# ---------------------------------------------------------------- frontier
@query("pareto_frontier", f"""WITH {CUST} SELECT id FROM cu a WHERE NOT EXISTS (SELECT 1 FROM cu b WHERE b.bal >= a.bal AND b.total >= a.total AND b.n_orders <= a.n_orders AND (b.bal > a.bal OR b.total > a.total OR b.n_orders < a.n_orders))""")
def pareto_frontier(spark, d):
    """J17."""
    return J.non_dominated(_customers(spark, d), {"bal": 1, "total": 1, "n_orders": -1}).select("id")


@query("pareto_pairs", f"""WITH {CUST} SELECT id, k, (NOT EXISTS (SELECT 1 FROM cu b WHERE b.k = a.k AND b.bal >= a.bal AND b.total >= a.total AND (b.bal > a.bal OR b.total > a.total)))::INT AS efficient FROM cu a""")
def pareto_pairs(spark, d):
    """J17 on two axes."""
    return J.pareto_2d(_customers(spark, d), "bal", "total", ["k"]).select("id", "k", "efficient")


@query("deployability_matrix", f"""WITH {RUNS}, s AS (SELECT model, avg(f1_macro) AS source_f1 FROM runs WHERE "domain" = 'source_heldout' GROUP BY model), t AS (SELECT model, avg(f1_macro) AS target_f1, avg(fpr) AS fpr FROM runs WHERE "domain" = 'target' GROUP BY model)
SELECT t.model, round(source_f1, 6) AS source_f1, round(target_f1, 6) AS target_f1, round(target_f1 - (SELECT target_f1 FROM t WHERE model = 'stratified'), 6) AS target_above_floor, round(fpr * 240000e0, 4) AS false_alerts_per_hour, CAST(NULL AS DOUBLE) AS p99_latency_ms FROM t JOIN s USING (model)""")
def deployability_matrix(spark, d):
    """O20."""
    m = _matrix(spark, d)
    return r6(m).withColumn("false_alerts_per_hour", F.round("false_alerts_per_hour", 4))


def _matrix(spark, d):
    r = _runs(spark, d)
    src = r.filter("domain = 'source_heldout'").groupBy("model").agg(F.avg("f1_macro").alias("source_f1"))
    tgt = r.filter("domain = 'target'").groupBy("model").agg(F.avg("f1_macro").alias("target_f1"), (F.avg("fpr") * S.LAMBDA_B).alias("false_alerts_per_hour"))
    floor = tgt.filter("model = 'stratified'").select("target_f1").scalar()
    m = B.deployability_matrix(tgt.select("model"), [src, tgt.withColumn("target_above_floor", F.col("target_f1") - floor)])
    return m.withColumn("p99_latency_ms", F.lit(None).cast("double"))


AX = {"source_f1": 1, "target_f1": 1, "false_alerts_per_hour": -1}


@query("axis_wins", f"""WITH {RUNS}, m AS (SELECT model, avg(f1_macro) FILTER (WHERE "domain" = 'source_heldout') AS a, avg(f1_macro) FILTER (WHERE "domain" = 'target') AS b, -avg(fpr) FILTER (WHERE "domain" = 'target') AS c FROM runs GROUP BY model),
w AS (SELECT (SELECT model FROM m ORDER BY a DESC, model LIMIT 1) AS model, 'source_f1' AS ax UNION ALL SELECT (SELECT model FROM m ORDER BY b DESC, model LIMIT 1), 'target_f1' UNION ALL SELECT (SELECT model FROM m ORDER BY c DESC, model LIMIT 1), 'false_alerts_per_hour')
SELECT m.model, coalesce(string_agg(ax, ';' ORDER BY ax), '-') AS wins_on, count(ax) AS n_wins FROM m LEFT JOIN w USING (model) GROUP BY m.model""")
def axis_wins(spark, d):
    """A51."""
    return J.axis_wins(_matrix(spark, d).select("model", *AX), AX)


@query("published_ladder", f"""WITH {SCORES}, e AS (SELECT model, 'R' || (split_seed - 101) AS rung, y, score, is_copy FROM scores WHERE "domain" = 'target'), c AS (SELECT rung, model, count(*) FILTER (WHERE y = 1 AND score >= 0.5e0) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5e0) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5e0) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5e0) AS tn,
  count(*) FILTER (WHERE y = 0 AND score >= 0.5e0 AND NOT is_copy) AS cfp, count(*) FILTER (WHERE y = 0 AND score < 0.5e0 AND NOT is_copy) AS ctn FROM e GROUP BY ALL), b AS (SELECT *, {ba_sql()} AS ba, 0.5e0 * (tp / (tp + fn)::DOUBLE + ctn / (ctn + cfp)::DOUBLE) AS bc, tp / (tp + fn)::DOUBLE AS tpr, fp / (fp + tn)::DOUBLE AS fpr, cfp / (cfp + ctn)::DOUBLE AS cfpr FROM c),
z AS (SELECT b.*, r.ba - b.ba AS drop, r.bc - b.bc AS cdrop, {ppv_sql('b.tpr', 'b.fpr')} AS ppv FROM b LEFT JOIN b r ON r.model = b.model AND r.rung = 'R0')
SELECT rung, model, round(ba, 6) AS ba, round(bc, 6) AS ba_clean, round(drop, 6) AS ba_drop_from_r0, round(cdrop, 6) AS clean_ba_drop_from_r0, round(ppv, 6) AS ppv, round(fpr * 240000e0, 4) AS fa_h, (tpr >= 0.5e0 AND ppv >= 0.1e0 AND fpr * 240000e0 <= 200e0 AND drop <= 0.1e0)::INT AS verdict FROM z""")
def published_ladder(spark, d):
    """Split seeds stand for the rungs."""
    s = X.scores(spark, d).filter("domain = 'target'").withColumn("pred", C.predict()).withColumn("rung", F.concat(F.lit("R"), (F.col("split_seed") - 101).cast("string")))
    k = ["rung", "model"]
    a = C.detection_metrics(C.confusion(s, k)).select(*k, *C.CELLS, "balanced_accuracy")
    c = C.detection_metrics(C.confusion(s.filter(~F.col("is_copy")), k)).select(*k, *[F.col(x).alias(f"clean_{x}") for x in C.CELLS], F.col("balanced_accuracy").alias("clean_balanced_accuracy"))
    r = B.published_ladder(a.join(c, k).withColumn("feature_set", F.lit("top10")))
    return r6(r.select("rung", "model", "ba", "ba_clean", "ba_drop_from_r0", "clean_ba_drop_from_r0", "ppv", "verdict", "fa_h")).withColumn("fa_h", F.round("fa_h", 4))


@query("label_efficient_curve", f"""WITH {COUNTS}, st AS (SELECT model, split_seed, max(CASE WHEN tp / nullif(tp + fn, 0)::DOUBLE >= 0.5e0 THEN tau END) AS a, min(tau) AS b FROM counts WHERE "domain" = 'source_heldout' GROUP BY ALL), t AS (SELECT c.model, c.split_seed, tau, tp / (tp + fn)::DOUBLE AS recall, fp / (fp + tn)::DOUBLE AS fpr, {ba_sql()} AS ba, row_number() OVER (PARTITION BY c.model, c.split_seed ORDER BY abs(tau - coalesce(a, b)), tau) AS rn FROM counts c JOIN st USING (model, split_seed) WHERE "domain" = 'target'),
o AS (SELECT model, avg(fpr) AS fpr, avg(recall) AS recall, avg(fpr * 240000e0) AS al, count(*) FILTER (WHERE fpr * 240000e0 <= 200e0 AND recall >= 0.5e0) AS ok FROM t WHERE rn = 1 GROUP BY model), r AS (SELECT model, count(*) AS draws, avg(ba) AS ba, min(ba) AS lo, max(ba) AS hi FROM t WHERE abs(tau - 0.5e0) < 1e-9 GROUP BY model)
SELECT model, draws, round(ba, 6) AS ba, round(lo, 6) AS ba_min, round(hi, 6) AS ba_max, round(fpr, 6) AS fpr_at_tau_star, round(recall, 6) AS recall_at_tau_star, round(al, 4) AS alerts_at_tau_star, ok AS draws_meeting_alert_bound FROM r JOIN o USING (model)""")
def label_efficient_curve(spark, d):
    """Split seeds as the draws."""
    c = _counts(spark, d).withColumnRenamed("split_seed", "draw").persist()
    runs = c.filter(S.same_tau("tau", 0.5)).withColumn("balanced_accuracy", S.balanced_accuracy())
    r = B.label_efficient_curve(runs, c, ["model"], "source_heldout", "target")
    return r6(r).withColumn("alerts_at_tau_star", F.round("alerts_at_tau_star", 4))


# ----------------------------------------------------------------- latency
def _binom(q: str, p: str) -> str:
    return f"(SELECT min(k) FROM cdf WHERE cdf.k0 = z.k0 AND cdf.p = {p} AND c >= {q})"


LAT = """e AS (SELECT event_type AS k0, value FROM events), z AS (SELECT k0, count(*) AS n FROM e GROUP BY k0), qs AS (SELECT unnest([0.5e0, 0.95e0, 0.99e0]) AS p), pm AS (SELECT k0, p, n, unnest(range(n + 1)) AS k FROM z, qs),
cdf AS (SELECT k0, p, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))) OVER (PARTITION BY k0, p ORDER BY k) AS c FROM pm),
rk AS (SELECT k0, p, max(z.n) AS n, min(k) FILTER (WHERE c >= 0.025e0) AS lo, min(k) FILTER (WHERE c >= 0.975e0) AS hi FROM cdf JOIN z USING (k0) GROUP BY k0, p), o AS (SELECT k0, value, row_number() OVER (PARTITION BY k0 ORDER BY value) AS i FROM e),
ci AS (SELECT rk.k0, p, n, (SELECT quantile_cont(value, 0.5) FROM e WHERE e.k0 = rk.k0) AS q50, (SELECT quantile_cont(value, 0.95) FROM e WHERE e.k0 = rk.k0) AS q95, (SELECT quantile_cont(value, 0.99) FROM e WHERE e.k0 = rk.k0) AS q99,
  max(value) FILTER (WHERE i = greatest(lo - 1, 0) + 1) AS lo, max(value) FILTER (WHERE i = least(hi, n - 1) + 1) AS hi FROM rk JOIN o USING (k0) GROUP BY rk.k0, p, n)"""


@query("latency_quantile_ci", f"WITH {LAT} SELECT k0 AS event_type, n, p AS q, round(CASE p WHEN 0.5e0 THEN q50 WHEN 0.95e0 THEN q95 ELSE q99 END, 6) AS est, lo, hi FROM ci")
def latency_quantile_ci(spark, d):
    """A45."""
    return r6(L.quantile_order_ci(X.events(spark, d), "value", [0.5, 0.95, 0.99], ["event_type"]))


@query("budget_crossings", f"WITH {LAT} SELECT k0 AS event_type, hi, (SELECT min(b) FROM (SELECT unnest([1e0, 2e0, 5e0, 10e0, 20e0, 50e0, 100e0, 200e0, 500e0, 1000e0]) AS b) WHERE b >= hi) AS min_budget_ms FROM ci WHERE p = 0.99e0")
def budget_crossings(spark, d):
    """A46."""
    q = L.quantile_order_ci(X.events(spark, d), "value", [0.99], ["event_type"])
    return L.budget_crossings(q, "hi").select("event_type", "hi", "min_budget_ms")


@query("latency_ecdf", """WITH h AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY value) AS cum, sum(n) OVER (PARTITION BY event_type) AS nn FROM h) SELECT event_type, value, n, round((cum - n + 0.5e0) / nn, 6) AS ecdf_first, round((cum - 0.5e0) / nn, 6) AS ecdf_last FROM c""")
def latency_ecdf(spark, d):
    """A48."""
    e = L.ecdf(X.events(spark, d), "value", ["event_type"])
    return e.select("event_type", "value", "n", F.round("ecdf_first", 6).alias("ecdf_first"), F.round("ecdf_last", 6).alias("ecdf_last"))


_TERMS = {"t_ind_ms": "value", "t_q_ms": "value / 2", "t_feat_ms": "value / 4", "t_inf_ms": "value / 8", "t_act_ms": "value / 16", "t_feat1_ms": "value / 5", "t_inf1_ms": "value / 10"}


def _loop(spark, d):
    e = X.events(spark, d).withColumn("seq", F.col("event_id")).withColumn("n_ue", F.pmod("user_id", F.lit(5))).withColumn("warmup", F.lit(100))
    for k, v in _TERMS.items():
        e = e.withColumn(k, F.expr(v))
    return L.loop_latency(e, ["event_type"])


@query("loop_latency", """WITH e AS (SELECT event_type, value AS v FROM events WHERE event_id >= 100 AND user_id % 5 > 0), l AS (SELECT event_type, unnest(['t_ind', 't_q', 't_feat', 't_inf', 't_act', 't_feat1', 't_inf1', 'e2e_one', 'e2e_all']) AS term, unnest([v, v / 2, v / 4, v / 8, v / 16, v / 5, v / 10, v + v / 2 + v / 5 + v / 10 + v / 16, v + v / 2 + v / 4 + v / 8 + v / 16]) AS ms FROM e)
SELECT event_type, term, count(*) AS n, round(avg(ms), 6) AS mean, round(max(ms), 6) AS max FROM l GROUP BY ALL""")
def loop_latency(spark, d):
    """A47."""
    return r6(L.summarise(_loop(spark, d), "ms", ["event_type", "term"]))


@query("transport_share", """WITH e AS (SELECT event_type, value AS v FROM events WHERE event_id >= 100 AND user_id % 5 > 0) SELECT event_type, round((avg(v) + avg(v / 16)) / avg(v + v / 2 + v / 4 + v / 8 + v / 16), 6) AS transport_share FROM e GROUP BY 1""")
def transport_share(spark, d):
    """A47."""
    return r6(L.transport_share(_loop(spark, d), ["event_type"]))


@query("extraction_cost", """WITH c AS (SELECT user_id % 3 AS capture, event_type AS implementation, sum(floor(value * 100 + 0.5e0)::BIGINT) / 1e4 AS seconds, count(*) AS n_packets, count(DISTINCT user_id) AS n_flows, count(*) / 10e0 AS mb FROM events GROUP BY ALL)
SELECT capture, implementation, round(mb / seconds, 6) AS mb_per_s, round(seconds * 1e3 / n_flows, 4) AS ms_per_flow, round(seconds * 1e6 / n_packets, 2) AS us_per_packet, round((max(seconds) FILTER (WHERE implementation = 'click') OVER (PARTITION BY capture)) / seconds, 6) AS speed_up FROM c""")
def extraction_cost(spark, d):
    """A49."""
    c = X.events(spark, d).groupBy(F.pmod("user_id", F.lit(3)).alias("capture"), F.col("event_type").alias("implementation")).agg(
        (F.sum("cents") / 1e4).alias("seconds"), F.count(F.lit(1)).alias("n_packets"), F.count_distinct("user_id").alias("n_flows"), (F.count(F.lit(1)) / 10).alias("mb"))
    r = FL.extraction_cost(c, ["capture"], "click")
    return r.select("capture", "implementation", F.round("mb_per_s", 6).alias("mb_per_s"), F.round("ms_per_flow", 4).alias("ms_per_flow"), F.round("us_per_packet", 2).alias("us_per_packet"), F.round("speed_up", 6).alias("speed_up"))


# ------------------------------------------------------------- calibration
CAL = f"""{SCORES}, sc AS (SELECT model, y, score FROM scores WHERE "domain" = 'source_heldout')"""
TEMPS = "[" + ", ".join(repr(t) + "e0" for t in K.TEMPERATURES) + "]"


@query("temperature", f"""WITH {CAL}, lg AS (SELECT model, ln(greatest(least(score, 1e0 - 1e-6), 1e-6) / (1 - greatest(least(score, 1e0 - 1e-6), 1e-6))) AS l, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM sc GROUP BY model, score),
q AS (SELECT model, t, p, n, greatest(least(1e0 / (1e0 + exp(-l / t)), 1e0 - 1e-9), 1e-9) AS q FROM lg, (SELECT unnest({TEMPS}) AS t)), nl AS (SELECT model, t, -sum(p * ln(q) + n * ln(1e0 - q)) / sum(p + n) AS nll FROM q GROUP BY model, t)
SELECT model, round(arg_min(t, nll), 6) AS temperature, round(min(nll), 6) AS nll FROM nl GROUP BY model""")
def temperature(spark, d):
    """M11, temperature scaling."""
    s = X.scores(spark, d).filter("domain = 'source_heldout'")
    return r6(K.best_temperature(K.temperature_nll(s, ["model"]), ["model"]))


_PC = "greatest(least(score, 1e0 - 1e-12), 1e-12)"
_PQ = f"({_PC} / (1e0 - {_PC}) * ((0.002e0 / (1e0 - 0.002e0)) / (0.4e0 / (1e0 - 0.4e0))))"


@query("prior_correct", f"""WITH {SCORES} SELECT model, "domain", round(avg({_PQ} / (1e0 + {_PQ})), 6) AS mean_corrected, round(max({_PQ} / (1e0 + {_PQ})), 6) AS max_corrected FROM scores GROUP BY model, "domain\"""")
def prior_correct(spark, d):
    """M12."""
    s = X.scores(spark, d).withColumn("c", K.prior_correct("score", 0.4, 0.002))
    return r6(s.groupBy("model", "domain").agg(F.avg("c").alias("mean_corrected"), F.max("c").alias("max_corrected")))


_PE = _PQ.replace("0.002e0", "0.35e0")


@query("em_step", f"""WITH {SCORES} SELECT model, round(sum({_PE} / (1e0 + {_PE})) / count(*), 6) AS pi_next FROM scores WHERE "domain" = 'target' GROUP BY model""")
def em_step(spark, d):
    """One update from 0.35."""
    t = C.score_table(X.scores(spark, d).filter("domain = 'target'"), ["model"])
    return r6(K.em_step(t, 0.4, 0.35, ["model"]))


_PI = _PQ.replace("0.002e0", "pi")


@query("em_prior", f"""WITH RECURSIVE {SCORES}, hs AS (SELECT model, score, count(*) AS n FROM scores WHERE "domain" = 'target' GROUP BY ALL),
e AS (SELECT model, 0 AS i, 0.4e0 AS pi, 0.4e0 AS found, false AS done FROM models UNION ALL
  SELECT model, i + 1, least(greatest(new, 1e-6), 1 - 1e-6), CASE WHEN abs(new - pi) < 1e-8 THEN new ELSE least(greatest(new, 1e-6), 1 - 1e-6) END, abs(new - pi) < 1e-8
  FROM (SELECT model, any_value(i) AS i, any_value(pi) AS pi, sum({_PI} / (1e0 + {_PI}) * n) / sum(n) AS new FROM e JOIN hs USING (model) WHERE NOT done AND i < 200 GROUP BY model))
SELECT model, (SELECT sum(n)::BIGINT FROM hs WHERE hs.model = l.model) AS n, round(found, 6) AS pi_hat, l.i AS iterations FROM (SELECT model, max(i) AS i, arg_max(found, i) AS found FROM e GROUP BY model) l""")
def em_prior(spark, d):
    """M13 run to its fixed point for every model."""
    t = X.scores(spark, d).filter("domain = 'target'")
    return r6(K.em_priors(t, 0.4, ["model"]))


@query("bbse", f"""WITH {CAL}, c AS (SELECT model, count(*)::DOUBLE AS n, count(*) FILTER (WHERE y = 1 AND score >= 0.5e0) / count(*)::DOUBLE AS c11, count(*) FILTER (WHERE y = 0 AND score >= 0.5e0) / count(*)::DOUBLE AS c10, count(*) FILTER (WHERE y = 1 AND score < 0.5e0) / count(*)::DOUBLE AS c01, count(*) FILTER (WHERE y = 0 AND score < 0.5e0) / count(*)::DOUBLE AS c00 FROM sc GROUP BY model),
t AS (SELECT model, avg((score >= 0.5e0)::INT) AS m1 FROM scores WHERE "domain" = 'target' GROUP BY model), w AS (SELECT *, greatest(((1 - m1) * c11 - m1 * c01) / (c00 * c11 - c01 * c10), 0) * (c00 + c10) AS q0, greatest((m1 * c00 - (1 - m1) * c10) / (c00 * c11 - c01 * c10), 0) * (c01 + c11) AS q1 FROM c JOIN t USING (model))
SELECT model, round(least(greatest(q1 / (q0 + q1), 0), 1), 6) AS pi_hat FROM w""")
def bbse(spark, d):
    """M14."""
    s = X.scores(spark, d).withColumn("pred", C.predict())
    return r6(K.bbse_prior(s.filter("domain = 'source_heldout'"), s.filter("domain = 'target'"), ["model"]))


@query("auc_flips", f"""WITH {SCORES}, t AS (SELECT {KS}, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM scores GROUP BY {KS}, score), c AS (SELECT *, sum(n) OVER (PARTITION BY {KS} ORDER BY score) - n AS below, sum(p) OVER (PARTITION BY {KS}) AS np, sum(n) OVER (PARTITION BY {KS}) AS nn FROM t),
a AS (SELECT {KS}, sum(p * (below + 0.5e0 * n)) / (max(np)::DOUBLE * max(nn)) AS auc FROM c GROUP BY {KS}) SELECT {KS}, 'negated' AS calibrator, round(1 - auc, 6) AS roc_auc, round(auc, 6) AS raw_auc, round(1 - 2 * auc, 6) AS auc_change, (abs(1 - 2 * auc) > 0.5e0)::INT AS inverted FROM a""")
def auc_flips(spark, d):
    """A calibrator that reverses the order."""
    s = X.scores(spark, d)
    s = s.withColumn("calibrator", F.explode(F.array(F.lit("raw"), F.lit("negated")))).withColumn("score", F.when(F.col("calibrator") == "raw", F.col("score")).otherwise(1.0 - F.col("score")))
    r = C.rank_metrics(s, [*KEYS, "calibrator"]).select(*KEYS, "calibrator", "roc_auc")
    return r6(C.auc_flips(r, KEYS))


@query("reference_equivalence", f"""WITH {SCORES}, e AS (SELECT model, score AS a, floor(score * 100) / 100 AS b FROM scores) SELECT model, round(max(abs(a - b)), 6) AS max_abs_diff, round(quantile_cont(abs(a - b), 0.99), 6) AS p99_abs_diff, round(avg(((a >= 0.5e0) = (b >= 0.5e0))::INT), 6) AS decision_agreement FROM e GROUP BY model""")
def reference_equivalence(spark, d):
    """A scorer against its two-decimal copy."""
    s = X.scores(spark, d).withColumn("b", F.floor(F.col("score") * 100) / 100)
    return r6(C.reference_equivalence(s, ["model"], "score", "b"))


# ------------------------------------------------------- nearest neighbour
NN = f"""v AS (SELECT vec_id, label, label % 2 AS y, {u("'nn' || vec_id")} < 0.2e0 AS test, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM v WHERE NOT test GROUP BY i),
z AS (SELECT vec_id, label, y, test, i, (x - m) / CASE WHEN s = 0 THEN 1 ELSE s END AS x FROM v JOIN st USING (i)), ds AS (SELECT q.vec_id AS q, t.vec_id AS t, max(q.label) AS ql, max(t.label) AS tl, max(q.y) AS qy, max(t.y) AS ty, sum((q.x - t.x) * (q.x - t.x)) AS d FROM z q JOIN z t ON q.i = t.i AND q.test AND NOT t.test GROUP BY q.vec_id, t.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) AS rn FROM ds), c AS (SELECT count(*) AS n_test, avg((ql = tl)::INT) AS sg, avg((qy = ty)::INT) AS la, count(*) FILTER (WHERE qy = 1 AND ty = 1) AS tp, count(*) FILTER (WHERE qy = 0 AND ty = 1) AS fp, count(*) FILTER (WHERE qy = 1 AND ty = 0) AS fn, count(*) FILTER (WHERE qy = 0 AND ty = 0) AS tn FROM nn WHERE rn = 1)"""


@query("nn_probe", f"WITH {NN} SELECT n_test, round(sg, 6) AS nn_same_group, round(la, 6) AS nn1_label_agreement, tp, fp, fn, tn, round({_F1}, 6) AS nn1_f1_macro FROM c")
def nn_probe(spark, d):
    """J16."""
    e = X.table(spark, d, "embeddings").withColumn("y", F.pmod("label", F.lit(2)))
    test = S.hash_unit(F.concat(F.lit("nn"), F.col("vec_id").cast("string"))) < 0.2
    dim = len(e.select("embedding").first()[0])
    return r6(J.nn_probe(e.filter(~test), e.filter(test), "embedding", "vec_id", "label", "y", dim))
