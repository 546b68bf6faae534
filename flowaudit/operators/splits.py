"""Sampling and leakage-safe splits as assignment tables.

Every random choice is the order of an md5 hash of (seed, key), so a re-run, a retry of a
lost task and a SQL engine agree. Group splits work on a summary with one row per group.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S


class LeakageError(AssertionError):
    """A split that claims to be disjoint is not."""


def _seeds(df: DataFrame, seeds: list[int], name: str = "split_seed") -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(s)) for s in seeds])))


def side(test: Column) -> Column:
    return F.when(test, "test").otherwise("train")


def group_summary(df: DataFrame, grp: str, y: str = "y", category: str | None = None) -> DataFrame:
    """Rows and attacks per group, and its dominant category (lowest tie)."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("n1")]
    if category:
        aggs.append(F.mode(category, True).alias("category"))
    return df.groupBy(F.col(grp).cast("string").alias("grp")).agg(*aggs)


def subsample(df: DataFrame, n: int, seed: int, row_id: str, keys: list[str] = ()) -> DataFrame:
    """D1. n rows without replacement (all of them where there are no more)."""
    d = O.first_n_by_hash(df, S.hash_int(F.lit(f"sub{seed}"), row_id), [row_id], F.lit(n), keys, "_pick")
    return d.filter("_pick").drop("_pick")


def random_split(df: DataFrame, seeds: list[int], row_id: str, test_frac: float = 0.2) -> DataFrame:
    """D2. The first int(n·(1-f)) rows of each seed's order train, the rest test."""
    d = _seeds(df, seeds)
    cut = F.floor(F.col("_all") * (1.0 - test_frac))
    d = O.first_n_by_hash(d, S.hash_int(F.lit("rs"), "split_seed", row_id), [row_id], cut, ["split_seed"], "_train")
    return d.withColumn("side", side(~F.col("_train"))).drop("_train")


def group_disjoint_split(groups: DataFrame, seeds: list[int], test_frac: float = 0.2,
                         min_test_groups: int = 2) -> DataFrame:
    """D3, plain form: groups go to test in hash order until int(n·frac) rows and min groups."""
    tot = groups.agg(F.sum("n")).scalar()
    d = _seeds(groups, seeds)
    d = d.withColumn("_h", S.hash_int(F.lit("gd"), "split_seed", "grp"))
    d = d.withColumn(O.BUCKET, O.hash_bucket(F.col("_h")))
    d = O.running_sums(d, ["_h", "grp"], {"_rows": F.col("n"), "_rank": F.lit(1)}, ["split_seed"])
    test = (F.col("_rows") - F.col("n") < F.floor(tot * test_frac)) | (F.col("_rank") <= min_test_groups)
    return d.withColumn("side", side(test)).drop("_h", O.BUCKET, "_rows", "_rank")


def _greedy(groups: DataFrame, order: list, step: Callable[[], Callable], out_type: str) -> DataFrame:
    """Run a sequential rule over each seed's groups in order.

    The rule sees the group summary as a stream with state of fixed size; nothing is
    gathered. One seed is one stream, and seeds run in parallel.
    """
    d = groups.withColumn("_h", order[0]).repartition("split_seed").sortWithinPartitions("split_seed", *order[1:])
    schema = f"split_seed int, grp string, n long, n1 long, choice {out_type}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, rule = None, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.split_seed != seed:
                    if rule is not None:
                        rows += rule(None)
                    seed, rule = r.split_seed, step()
                rows += rule(r)
            yield pd.DataFrame(rows, columns=["split_seed", "grp", "n", "n1", "choice"])
        if rule is not None:
            yield pd.DataFrame(rule(None), columns=["split_seed", "grp", "n", "n1", "choice"])

    return d.select("split_seed", "grp", "n", "n1", *[c for c in d.columns if c.startswith("_")]) \
        .mapInPandas(run, schema)


def balanced_group_split(groups: DataFrame, seeds: list[int], test_frac: float = 0.2,
                         min_test_groups: int = 2, look_ahead: int = 8) -> DataFrame:
    """D3, balanced form: of the next 8 unused groups, take the one that keeps the test
    prevalence nearest to the overall one, until the test side is large enough.

    The picks of a seed follow each other in one task, over the groups that running sums show
    to be near enough to the front; the others train.
    """
    n, n1 = groups.agg(F.sum("n"), F.sum("n1")).first()
    target, overall = int(n * test_frac), n1 / n

    def rule():
        pool, st = [], {"n": 0, "n1": 0, "k": 0}

        def out(r, test):
            return (r.split_seed, r.grp, r.n, r.n1, "test" if test else "train")

        def done():
            return st["n"] >= target and st["k"] >= min_test_groups

        def pick():
            errs = [abs((st["n1"] + p.n1) / (st["n"] + p.n) - overall) for p in pool]
            p = pool.pop(errs.index(min(errs)))
            st["n"] += p.n
            st["n1"] += p.n1
            st["k"] += 1
            return out(p, True)

        def feed(r):
            rows = []
            if r is None:
                while pool and not done():
                    rows.append(pick())
                rows += [out(p, False) for p in pool]
                pool.clear()
                return rows
            if done():
                rows += [out(p, False) for p in pool] + [out(r, False)]
                pool.clear()
                return rows
            pool.append(r)
            if len(pool) == look_ahead:
                rows.append(pick())
            return rows
        return feed

    d = _seeds(groups, seeds).withColumn("_h", S.hash_int(F.lit("gd"), "split_seed", "grp"))
    sums = O.running_sums(d.withColumn(O.BUCKET, O.hash_bucket(F.col("_h"))), ["_h", "grp"], {"_rows": F.col("n"), "_rank": F.lit(1)}, ["split_seed"])
    # of the groups in front of one that is looked at, all but `look_ahead` are on a test side that is still too small
    largest = groups.agg(F.max("n")).first()[0] or 0
    near = (F.col("_rows") - F.col("n") - look_ahead * largest < target) | (F.col("_rank") <= min_test_groups + look_ahead)
    sums = sums.withColumn("_near", near)
    r = _greedy(sums.filter("_near").drop("_h"), [S.hash_int(F.lit("gd"), "split_seed", "grp"), "_h", "grp"], rule, "string").withColumnRenamed("choice", "side")
    return r.unionByName(sums.filter("NOT _near").select("split_seed", "grp", "n", "n1", F.lit("train").alias("side")))


def stratified_group_split(groups: DataFrame, seeds: list[int], test_frac: float = 0.2) -> DataFrame:
    """D4. Per dominant category max(1, round(m·f)) groups, at most m-1, go to test."""
    m = F.col("_all")
    k = F.when(m <= 1, 0).otherwise(F.least(F.greatest(F.bround(m * test_frac).cast("long"), F.lit(1)), m - 1))
    d = O.first_n_by_hash(_seeds(groups, seeds), S.hash_int(F.lit("sg"), "split_seed", "grp"), ["grp"], k,
                          ["split_seed", "category"], "_test")
    return d.withColumn("side", side(F.col("_test"))).drop("_test")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so it is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _exact_div(a: Column, b: Column) -> Column:
    """Whole quotient rounded down, also of negative numbers, without doubles."""
    return F.call_function("div", a - F.pmod(a, b), b)


def _deal(loads: Column, size: Column, c: Column, then: Callable[[Column, Column, Column], Column]) -> Column:
    """Give c items of one size, one after the other, to the lightest of some loads (ties: the first).

    A load is q sizes and a remainder e. Item after item goes by (q + items got, e, place), so
    all that a load with q below some round gets before it is round - q. The largest round that
    c items complete is a minimum over how many loads take part. `then` is given the items each
    load got in whole rounds, how many are left, and the order (e, place) in which they go on.
    """
    q = F.transform(loads, lambda x: _exact_div(x, size))
    smallest = lambda qs: F.transform(F.sequence(F.lit(1), F.size(qs)), lambda i: _exact_div(
        c + F.aggregate(F.slice(F.array_sort(qs), F.lit(1), i), F.lit(0).cast("bigint"), lambda x, y: x + y), i.cast("bigint")))

    def at_round(qs: Column, last: Column) -> Column:
        whole = F.transform(qs, lambda x: F.greatest(F.lit(0).cast("bigint"), last - x))
        left = c - F.aggregate(whole, F.lit(0).cast("bigint"), lambda x, y: x + y)
        order = F.array_sort(F.filter(F.transform(loads, lambda x, j: F.when(F.get(qs, j) <= last, F.struct(F.pmod(x, size).alias("e"), j.alias("j")))),
                                      lambda x: x.isNotNull()))
        return then(whole, left, order)

    return _let(q, lambda qs: _let(F.array_min(smallest(qs)), lambda last: at_round(qs, last)))


def _dealt(loads: Column, size: Column, c: Column) -> Column:
    """The loads after c items of one size."""
    def add(whole: Column, left: Column, order: Column) -> Column:
        return _let(F.struct(whole.alias("w"), F.transform(F.slice(order, F.lit(1), left.cast("int")), lambda x: x["j"]).alias("more")),
                    lambda s: F.transform(loads, lambda x, j: x + size * (F.get(s["w"], j) + F.when(F.array_contains(s["more"], j), 1).otherwise(0))))
    return _deal(loads, size, c, add)


def _taker(loads: Column, size: Column, r: Column) -> Column:
    """The load that takes the item after r others of its size."""
    return _deal(loads, size, r, lambda whole, left, order: F.get(order, left.cast("int"))["j"])


def deal_groups(groups: DataFrame, start: list[int], scale: int, run_order: list[Column], tie: Column, chunk: int = 1024) -> DataFrame:
    """Groups of (split_seed, grp, n), run after run of equal n, each to the lightest load: adds `choice`.

    The walk goes over runs, fewer than the square root of twice the rows, and moves by a whole
    run in closed form. Loads are noted at every 1,024th run, and then inside these chunks, side
    by side, so no list of the length of the walk is copied at each step. A group finds its
    choice by its rank in the run; ranks come from buckets of the hash, so a run of a third of
    all groups is many tasks.
    """
    size = (F.col("n") * scale).cast("bigint")
    runs = groups.groupBy("split_seed", "n").agg(F.count(F.lit(1)).alias("_c"))
    seq = runs.groupBy("split_seed").agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(run_order)], "n", size.alias("s"), "_c"))).alias("_runs"))
    first = F.array(*[F.lit(x).cast("bigint") for x in start])
    none = F.array().cast("array<array<bigint>>")

    def mark(a: Column, r: Column) -> Column:
        at = F.when(a["k"] % chunk == 0, F.concat(a["marks"], F.array(a["loads"]))).otherwise(a["marks"])
        return F.struct(_dealt(a["loads"], r["s"], r["_c"]).alias("loads"), (a["k"] + 1).alias("k"), at.alias("marks"))

    def note(a: Column, r: Column) -> Column:
        return F.struct(_dealt(a["loads"], r["s"], r["_c"]).alias("loads"), F.concat(a["marks"], F.array(a["loads"])).alias("marks"))

    marks = F.aggregate("_runs", F.struct(first.alias("loads"), F.lit(0).alias("k"), none.alias("marks")), mark, lambda a: a["marks"])
    parts = seq.select("split_seed", "_runs", F.posexplode(marks).alias("_k", "_first"))
    parts = parts.select("split_seed", "_first", F.slice("_runs", F.col("_k") * chunk + 1, F.lit(chunk)).alias("_part"))
    inside = F.aggregate("_part", F.struct(F.col("_first").alias("loads"), none.alias("marks")), note, lambda a: a["marks"])
    at = parts.select("split_seed", F.explode(F.arrays_zip("_part", inside.alias("_at"))).alias("_x"))
    at = at.select("split_seed", F.col("_x._part.n").alias("n"), F.col("_x._at").alias("_loads"))
    ranked = O.hash_rank(groups, tie, ["grp"], ["split_seed", "n"], "_rank")
    return ranked.join(at, ["split_seed", "n"]) \
        .withColumn("choice", _taker(F.col("_loads"), size, F.col("_rank").cast("bigint") - 1).cast("int")).drop("_rank", "_loads")


def three_way_group_split(groups: DataFrame, seeds: list[int], fracs=(0.6, 0.2, 0.2)) -> DataFrame:
    """D5. Each group goes to the side with the largest deficit, sizes in the order of a hash.

    Groups of equal size follow each other, in the order of another hash. Deficits are compared
    as whole numbers.
    """
    n = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = [Fraction(str(f)) for f in fracs]
    scale = math.lcm(*[f.denominator for f in shares])
    r = deal_groups(_seeds(groups, seeds), [-int(f * scale) * n for f in shares], scale, [S.hash_int(F.lit("tw"), "split_seed", "n")],
                    S.hash_int(F.lit("tw"), "split_seed", "grp"))
    names = F.array(*[F.lit(x) for x in ("train", "calibration", "test")])
    return r.select("split_seed", "grp", "n", "n1", F.get(names, F.col("choice")).alias("side"))


def group_k_fold(groups: DataFrame, k: int = 5) -> DataFrame:
    """D10. Groups by falling size, each to the lightest fold; every group is tested once."""
    d = groups.withColumn("split_seed", F.lit(0))
    r = deal_groups(d, [0] * k, 1, [-F.col("n")], S.hash_int(F.lit("kf"), "grp"))
    return r.select("grp", "n", "n1", F.col("choice").alias("fold"))


def overlapping_groups(assign: DataFrame, grp: str = "grp", split: str = "split_seed") -> DataFrame:
    """D6. Groups that appear on more than one side of a split."""
    g = assign.groupBy(split, grp).agg(F.count_distinct("side").alias("n_sides"))
    return g.filter(F.col("n_sides") > 1)


def check_disjoint(assign: DataFrame, grp: str = "grp", split: str = "split_seed") -> None:
    """D6. Raise if a group is on both sides."""
    bad = overlapping_groups(assign, grp, split).limit(5).collect()
    if bad:
        raise LeakageError(f"group(s) on both sides, e.g. {[tuple(r)[:2] for r in bad]}")


def apply_split(df: DataFrame, assign: DataFrame, grp: str) -> DataFrame:
    """Rows with the side of their group, one copy per split.

    Rows stay where they are as long as the assignment, a row a group and split, is small.
    """
    a = O.small(assign.select("split_seed", F.col("grp").alias("_g"), "side"))
    return df.join(a, F.col(grp).cast("string") == F.col("_g")).drop("_g")


def split_stats(rows: DataFrame, grp: str = "grp", y: str = "y") -> DataFrame:
    """Sizes, groups and prevalences of the two sides of every split."""
    tr, te = F.col("side") == "train", F.col("side") == "test"
    return rows.groupBy("split_seed").agg(
        F.count_if(tr).alias("n_train"), F.count_if(te).alias("n_eval"),
        F.count_distinct(F.when(tr, F.col(grp))).alias("n_train_groups"),
        F.count_distinct(F.when(te, F.col(grp))).alias("n_test_groups"),
        F.avg(F.when(tr, F.col(y))).alias("train_prevalence"), F.avg(F.when(te, F.col(y))).alias("test_prevalence"))


def file_draw(files: DataFrame, ks: list[int], draws: int, file: str = "file") -> DataFrame:
    """D7, U6. k files drawn per (k, draw); the others are held out."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("draw")) for k in ks for r in range(draws)])
    d = files.select(file).distinct().withColumn("_x", F.explode(grid)).select(file, "_x.k", "_x.draw")
    d = O.first_n_by_hash(d, S.hash_int(F.lit("fd"), "k", "draw", file), [file],
                          F.col("k"), ["k", "draw"], "_in")
    return d.withColumn("side", F.when(F.col("_in"), "labelled").otherwise("held_out")).drop("_in")


def leave_one_group_out(df: DataFrame, grp: str, y: str = "y") -> DataFrame:
    """D8. One unit per group: its rows test, all others train. Sizes come from totals."""
    g = df.groupBy(F.col(grp).alias("unit")).agg(F.count(F.lit(1)).alias("n_test"), F.sum(y).alias("test_attacks"))
    N, A = (df.agg(e).scalar() for e in (F.count(F.lit(1)), F.sum(y)))
    g = g.withColumn("n_train", N - F.col("n_test")).withColumn("train_attacks", A - F.col("test_attacks"))
    one = (F.col("test_attacks") == 0) | (F.col("test_attacks") == F.col("n_test"))
    return g.withColumn("single_class", one.cast("int"))


def unit_side(df: DataFrame, grp: str, unit) -> DataFrame:
    """D8. Sides of one unit."""
    return df.withColumn("side", side(F.col(grp) == F.lit(unit)))


def station_split(df: DataFrame, file: str, last_of_first: int) -> DataFrame:
    """D9. Files up to a number are station 1; both directions."""
    st = F.when(F.col(file) <= last_of_first, 1).otherwise(2)
    d = df.withColumn("_st", st).withColumn("direction", F.explode(F.array(F.lit("s1_to_s2"), F.lit("s2_to_s1"))))
    test = F.when(F.col("direction") == "s1_to_s2", F.col("_st") == 2).otherwise(F.col("_st") == 1)
    return d.withColumn("side", side(test)).drop("_st")


def temporal_split(sessions: DataFrame, fracs: list[float], session: str = "session") -> DataFrame:
    """D11. First k = round(f·n) sessions against the rest, forward and reverse."""
    n = sessions.agg(F.count_distinct(session)).scalar()
    d = sessions.withColumn("_r", F.dense_rank().over(Window.orderBy(session)))
    grid = F.array(*[F.struct(F.lit(f).alias("train_frac"), F.lit(x).alias("direction"))
                     for f in fracs for x in ("forward", "reverse")])
    d = d.withColumn("_g", F.explode(grid)).select("*", "_g.train_frac", "_g.direction").drop("_g")
    early = F.col("_r") <= F.bround(F.col("train_frac") * n)
    test = F.when(F.col("direction") == "forward", ~early).otherwise(early)
    return d.withColumn("side", side(test)).drop("_r")


def random_session_control(sessions: DataFrame, fracs: list[float], reps: int, session: str = "session") -> DataFrame:
    """D12. The same session counts drawn at random."""
    grid = F.array(*[F.struct(F.lit(f).alias("train_frac"), F.lit(r).alias("rep")) for f in fracs for r in range(reps)])
    d = sessions.withColumn("_g", F.explode(grid)).select("*", "_g.train_frac", "_g.rep").drop("_g")
    k = F.bround(F.col("train_frac") * F.col("_all"))
    d = O.first_n_by_hash(d, S.hash_int(F.lit("rc"), "rep", session), [session], k, ["train_frac", "rep"], "_tr")
    return d.withColumn("side", side(~F.col("_tr"))).drop("_tr")


def time_stratified_split(sessions: DataFrame, category: str = "category", session: str = "session",
                          check: bool = False) -> DataFrame:
    """D13. The latest (forward) or earliest (reverse) session of every category is tested."""
    ends = sessions.groupBy(category).agg(F.max(session).alias("_hi"), F.min(session).alias("_lo"),
                                          F.count(F.lit(1)).alias("_n"))
    if check and ends.filter(F.col("_n") < 2).take(1):
        raise ValueError("every category needs two sessions")
    d = sessions.join(ends, category).withColumn("direction", F.explode(F.array(F.lit("forward"), F.lit("reverse"))))
    test = F.when(F.col("direction") == "forward", F.col(session) == F.col("_hi")).otherwise(
        F.col(session) == F.col("_lo"))
    return d.withColumn("side", side(test)).drop("_hi", "_lo", "_n")


def random_stratified_control(sessions: DataFrame, reps: int, category: str = "category",
                              session: str = "session") -> DataFrame:
    """D13 control: one random session of every category per draw."""
    d = sessions.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    d = O.first_n_by_hash(d, S.hash_int(F.lit("rz"), "rep", session), [session], F.lit(1), ["rep", category], "_te")
    return d.withColumn("side", side(F.col("_te"))).drop("_te")


def coverage_audit(assign: DataFrame, keys: list[str], category: str = "category", session: str = "session",
                   benign: str = "benign") -> DataFrame:
    """D14, U2. Per split: test categories, those unseen in training, benign sessions by side."""
    te, tr = F.col("side") == "test", F.col("side") == "train"
    b = F.col(category) == benign
    g = assign.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(te, F.col(category)))).alias("_ct"),
        F.collect_set(F.when(tr, F.col(category))).alias("_cr"),
        F.count_distinct(F.when(te, F.col(session))).alias("n_test_sessions"),
        F.count_distinct(F.when(tr, F.col(session))).alias("n_train_sessions"),
        F.count_if(te & b).alias("n_benign_test_sessions"), F.count_if(tr & b).alias("n_benign_train_sessions"))
    unseen = F.array_except("_ct", "_cr")
    return g.select(*keys, F.concat_ws(",", "_ct").alias("test_categories"),
                    F.concat_ws(",", unseen).alias("unseen_test_categories"),
                    F.size(F.filter(unseen, lambda c: c != benign)).alias("n_unseen_attack_categories"),
                    "n_test_sessions", "n_train_sessions", "n_benign_test_sessions", "n_benign_train_sessions")


def stratified_random_split(df: DataFrame, row_id: str, seed: int, test_frac: float = 0.30, y: str = "y") -> DataFrame:
    """D15. round(f·n) rows of every class are tested."""
    k = F.bround(F.col("_all") * test_frac)
    d = O.first_n_by_hash(df, S.hash_int(F.lit(f"sr{seed}"), row_id), [row_id], k, [y], "_te")
    return d.withColumn("side", side(F.col("_te"))).drop("_te")


def size_matched_grouping(df: DataFrame, grp: str, row_id: str, seed: int = 0, step: int = 1000) -> DataFrame:
    """D16. Random groups with the size profile of `grp`: rows in hash order, cut at the
    cumulative sizes (largest first). Ranks meet their range in steps, so a group that
    holds a third of all rows is many join keys.
    """
    sizes = df.groupBy(F.col(grp).cast("string").alias("_g")).agg(F.count(F.lit(1)).alias("s"))
    hist = O.running_sums(sizes.withColumn(O.BUCKET, -F.col("s")), [F.col("_g")],
                          {"_hi": F.col("s"), "_idx": F.lit(1)})
    rng = hist.select((F.col("_idx") - 1).alias("fake_grp"), (F.col("_hi") - F.col("s") + 1).alias("_lo"), "_hi")
    rng = rng.withColumn("_st", F.explode(F.sequence(F.floor(F.col("_lo") / step), F.floor(F.col("_hi") / step))))
    r = O.hash_rank(df, S.hash_int(F.lit(f"sm{seed}"), row_id), [row_id], name="_rk")
    r = r.withColumn("_st", F.floor(F.col("_rk") / step)).join(rng, "_st")
    return r.filter((F.col("_rk") >= F.col("_lo")) & (F.col("_rk") <= F.col("_hi"))).drop("_rk", "_lo", "_hi", "_st")


def shuffle_labels(df: DataFrame, label: str, row_id: str, reps: int | list[int], keep: list[str]) -> DataFrame:
    """D17. Per replicate the labels in one hash order meet the rows in another. `reps` may name the replicates, which do not depend on each other."""
    reps = list(range(reps)) if isinstance(reps, int) else reps
    d = df.select(row_id, label, *keep).withColumn("rep", F.explode(F.array(*[F.lit(r) for r in reps])))
    a = O.hash_rank(d.drop(label), S.hash_int(F.lit("sl0"), "rep", row_id), [row_id], ["rep"], "_rk")
    b = O.hash_rank(d.select("rep", row_id, F.col(label).alias(f"{label}_shuffled")),
                    S.hash_int(F.lit("sl1"), "rep", row_id), [row_id], ["rep"], "_rk").drop(row_id)
    return a.join(b, ["rep", "_rk"]).drop("_rk")


def label_efficient_pool(source_train: DataFrame, target: DataFrame, variant: str, seed: int, row_id: str,
                         n_with_source: int = 60_000, n_only: int = 240_000, copy: str = "is_copy",
                         y: str = "y") -> DataFrame:
    """D19. Source training rows plus a sample of labelled target rows, or target rows only.

    `target` holds the labelled files; flagged copies count as attacks.
    """
    t = target.withColumn(y, F.when(F.col(copy), F.lit(1)).otherwise(F.col(y)))
    if variant == "target-only":
        return subsample(t, n_only, seed, row_id)
    if variant == "source+k":
        return source_train.unionByName(subsample(t, n_with_source, seed, row_id), allowMissingColumns=True)
    raise ValueError(f"unknown variant {variant!r}")
