import hashlib

import pytest
from pyspark.sql import functions as F

from flowaudit.operators import splits as D


def h(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@pytest.fixture(scope="module")
def corpus(spark):
    # one source holds a third of all rows
    g = F.when(F.col("id") % 3 == 0, F.lit("g0")).otherwise(F.concat(F.lit("g"), (F.col("id") % 19 + 1).cast("string")))
    return spark.range(900).select(F.col("id").alias("row_id"), g.alias("grp"), (F.col("id") * 7 % 10 < 6).cast("int").alias("y"),
                                   F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("category")).persist()


def test_random_split_sizes_and_order(corpus):
    s = D.random_split(corpus, [1, 2], "row_id")
    assert {(r.split_seed, r.side): r["count"] for r in s.groupBy("split_seed", "side").count().collect()} == {
        (1, "train"): 720, (1, "test"): 180, (2, "train"): 720, (2, "test"): 180}
    want = {i for i in sorted(range(900), key=lambda i: (h(f"rs|1|{i}"), i))[720:]}
    assert {r.row_id for r in s.filter("split_seed = 1 and side = 'test'").collect()} == want


def test_group_split_is_disjoint_and_large_enough(corpus):
    g = D.group_summary(corpus, "grp")
    a = D.group_disjoint_split(g, [1, 2, 3])
    D.check_disjoint(a)
    sizes = {r.split_seed: r.n for r in a.filter("side = 'test'").groupBy("split_seed").agg(F.sum("n").alias("n")).collect()}
    assert all(v >= 180 for v in sizes.values())


def test_balanced_split_follows_the_rule(corpus):
    g = D.group_summary(corpus, "grp")
    rows = {r.grp: (r.n, r.n1) for r in g.collect()}
    n, n1 = sum(v[0] for v in rows.values()), sum(v[1] for v in rows.values())
    a = D.balanced_group_split(g, [5, 6])
    for seed in (5, 6):
        order = sorted(rows, key=lambda k: (h(f"gd|{seed}|{k}"), k))
        test, cn, c1 = [], 0, 0
        while not (cn >= int(n * 0.2) and len(test) >= 2):
            cand = [x for x in order if x not in test][:8]
            best = min(cand, key=lambda k: abs((c1 + rows[k][1]) / (cn + rows[k][0]) - n1 / n))
            test.append(best)
            cn, c1 = cn + rows[best][0], c1 + rows[best][1]
        assert {r.grp for r in a.filter((F.col("split_seed") == seed) & (F.col("side") == "test")).collect()} == set(test)


def test_guard_fires(spark):
    a = spark.createDataFrame([(1, "g", "train"), (1, "g", "test")], "split_seed int, grp string, side string")
    with pytest.raises(D.LeakageError):
        D.check_disjoint(a)


def test_single_group_category_stays_in_train(spark):
    g = spark.createDataFrame([("a", 5, 1, "x"), ("b", 5, 1, "y"), ("c", 5, 1, "y")], "grp string, n long, n1 long, category string")
    s = {r.grp: r.side for r in D.stratified_group_split(g, [1]).collect()}
    assert s["a"] == "train" and sorted([s["b"], s["c"]]) == ["test", "train"]


def test_three_way_covers_every_group_once(corpus):
    g = D.group_summary(corpus, "grp")
    a = D.three_way_group_split(g, [1])
    assert a.count() == g.count() and a.select("side").distinct().count() == 3


def test_k_fold_tests_each_group_once(corpus):
    g = D.group_summary(corpus, "grp")
    a = D.group_k_fold(g, 5).collect()
    assert len(a) == g.count()
    load = [sum(r.n for r in a if r.fold == k) for k in range(5)]
    assert sum(load) == 900 and sorted(load)[1] > 100


@pytest.mark.parametrize("chunk", [1024, 3])
def test_dealing_by_runs_equals_dealing_one_by_one(spark, chunk):
    # a third of all groups have one size
    sizes = [7 if k % 3 == 0 else (k * k) % 61 + 1 for k in range(300)] + [500]
    g = spark.createDataFrame([(f"g{k}", n, n // 2) for k, n in enumerate(sizes)], "grp string, n long, n1 long")
    total = sum(sizes)
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], h(f"x|g{k}"), f"g{k}"))
    for start, scale in (([0] * 5, 1), ([-6 * total, -2 * total, -2 * total], 10), ([3], 1)):
        d = D.deal_groups(g.withColumn("split_seed", F.lit(1)), start, scale, [-F.col("n")], D.S.hash_int(F.lit("x"), "grp"), chunk)
        got = {r.grp: r.choice for r in d.collect()}
        load = list(start)
        for k in order:
            j = load.index(min(load))
            load[j] += scale * sizes[k]
            assert got[f"g{k}"] == j


def test_three_way_takes_the_largest_deficit(corpus):
    g = {r.grp: r.n for r in D.group_summary(corpus, "grp").collect()}
    got = {r.grp: r.side for r in D.three_way_group_split(D.group_summary(corpus, "grp"), [9]).collect()}
    have = dict.fromkeys(("train", "calibration", "test"), 0)
    for k in sorted(g, key=lambda k: (h(f"tw|9|{g[k]}"), g[k], h(f"tw|9|{k}"), k)):
        side = max(have, key=lambda s: {"train": 3, "calibration": 1, "test": 1}[s] * 900 - 5 * have[s])
        have[side] += g[k]
        assert got[k] == side


def test_group_splits_of_nothing(spark):
    g = spark.createDataFrame([], "grp string, n long, n1 long")
    assert D.three_way_group_split(g, [1]).count() == 0 and D.group_k_fold(g).count() == 0


def test_subsample_is_exact_and_whole_where_small(corpus):
    assert D.subsample(corpus, 100, 3, "row_id").count() == 100
    assert D.subsample(corpus, 5000, 3, "row_id").count() == 900


def test_size_matched_profile(corpus):
    f = D.size_matched_grouping(corpus, "grp", "row_id", step=10)
    a = sorted(r["count"] for r in f.groupBy("fake_grp").count().collect())
    assert a == sorted(r["count"] for r in corpus.groupBy("grp").count().collect()) and f.count() == 900


def test_shuffled_labels_keep_their_counts(corpus):
    s = D.shuffle_labels(corpus, "y", "row_id", 2, ["grp"])
    for rep in (0, 1):
        assert s.filter(F.col("rep") == rep).agg(F.sum("y_shuffled")).first()[0] == corpus.agg(F.sum("y")).first()[0]


def test_leave_one_out_and_station(corpus):
    u = D.leave_one_group_out(corpus, "grp").collect()
    assert len(u) == 20 and all(r.n_train + r.n_test == 900 for r in u)


def test_label_efficient_variants(spark):
    src = spark.range(50).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), F.lit(False).alias("is_copy"))
    tgt = spark.range(100, 140).select(F.col("id").alias("row_id"), F.lit(0).alias("y"), F.lit(True).alias("is_copy"))
    p = D.label_efficient_pool(src, tgt, "source+k", 1, "row_id", n_with_source=10)
    assert p.count() == 60 and p.agg(F.sum("y")).first()[0] == 10
    assert D.label_efficient_pool(src, tgt, "target-only", 1, "row_id", n_only=15).count() == 15
