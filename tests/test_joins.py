import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowaudit.operators import audit as A
from flowaudit.operators import joins as J


@pytest.mark.parametrize("cell", [0.7, 5.0, 1000.0])
def test_nearest_in_time_against_a_loop(spark, cell):
    r = random.Random(4)
    a = [("x" if r.random() < 0.7 else "y", round(r.uniform(0, 60), 2)) for _ in range(150)]
    b = [("x" if r.random() < 0.7 else "z", round(r.uniform(0, 60), 2)) for _ in range(60)]
    da = spark.createDataFrame([(i, *v) for i, v in enumerate(a)], "id int, k string, ts double")
    got = {x.id: x for x in J.nearest_in_time(da, spark.createDataFrame(b, "k string, ts double"), ["k"], tol=2.0, cell_s=cell).collect()}
    for i, (k, t) in enumerate(a):
        cand = sorted((abs(u - t), u) for kk, u in b if kk == k)
        if not cand:
            assert got[i].dt is None and not got[i].matched
        else:
            assert got[i].dt == pytest.approx(cand[0][1] - t, abs=1e-9) and got[i].matched == (cand[0][0] <= 2.0)


def test_earlier_partner_wins_a_tie(spark):
    a, b = spark.createDataFrame([("k", 5.0)], "k string, ts double"), spark.createDataFrame([("k", 4.0), ("k", 6.0)], "k string, ts double")
    assert J.nearest_in_time(a, b, ["k"]).first().dt == -1.0


@pytest.mark.parametrize("chunk", [2_000, 7])
def test_frontier_against_all_pairs(spark, chunk):
    r = random.Random(8)
    pts = [(i, "ab"[i % 2], r.randrange(12), r.randrange(12), r.randrange(12)) for i in range(300)]
    d = spark.createDataFrame(pts, "id int, k string, x int, y int, z int").repartition(5)
    got = {p.id for p in J.non_dominated(d, {"x": 1, "y": 1, "z": -1}, ["k"], chunk=chunk).collect()}
    want = set()
    for p in pts:
        v = (p[2], p[3], -p[4])
        rest = [(q[2], q[3], -q[4]) for q in pts if q[1] == p[1]]
        if not any(all(a >= b for a, b in zip(q, v)) and q != v for q in rest):
            want.add(p[0])
    assert got == want


def test_frontier_of_rows_that_are_all_on_it(spark):
    """A third of the rows are one point, the others beat each other nowhere; one more is beaten."""
    pts = [(i, float(i), -float(i)) for i in range(400)] + [(1000 + i, 200.5, 3.0) for i in range(200)] + [(5000, 200.0, 2.0)]
    d = spark.createDataFrame(pts, "id int, x double, y double").repartition(6)
    got = sorted(p.id for p in J.non_dominated(d, {"x": 1, "y": 1}, chunk=50).collect())
    assert got == [i for i, x, y in pts if not (x <= 200.5 and y <= 3.0 and (x, y) != (200.5, 3.0))]


def test_axis_with_missing_values_is_left_out(spark):
    d = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0)], "m string, x double, y double")
    assert [r.m for r in J.non_dominated(d, {"x": 1, "y": 1}).collect()] == ["b"]


def test_pareto_pairs(spark):
    d = spark.createDataFrame([("a", 1, 5), ("b", 2, 4), ("c", 1, 4), ("d", 2, 4)], "m string, x int, y int").withColumn("k", F.lit(1))
    assert {r.m: r.efficient for r in J.pareto_2d(d, "x", "y", ["k"]).collect()} == {"a": 1, "b": 1, "c": 0, "d": 1}


@pytest.mark.parametrize("k, block", [(1, 8), (1, 4096), (5, 8), (5, 64)])
def test_neighbours_against_brute_force(spark, k, block):
    rng = np.random.default_rng(2)
    # half of the training rows sit in one tight clump, with exact copies
    x = np.concatenate([rng.normal(size=(60, 4)), 5 + 0.01 * rng.normal(size=(50, 4)), np.repeat([[5.0] * 4], 10, 0)])
    q = np.concatenate([rng.normal(size=(15, 4)), 5 + 0.01 * rng.normal(size=(15, 4))])
    tr = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "tid int, v array<double>")
    te = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, v array<double>")
    got = {}
    for r in J.nearest_neighbour(tr, te, "v", "tid", "qid", n_pivots=6, block_rows=block, k=k).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.tid))
    for i, v in enumerate(q):
        d = np.sqrt(((x - v) ** 2).sum(1))
        want = sorted(range(len(x)), key=lambda j: (d[j], j))[:k]
        assert [t for _, t in sorted(got[i])] == want


def test_neighbours_in_many_blocks_and_parts(spark, monkeypatch):
    """Bounds of blocks in several parts, ties of copies over blocks, null vectors and an empty training table."""
    monkeypatch.setattr(J, "PART_BLOCKS", 2)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(0, 3, size=(150, 3)).astype(float), 1e4 + rng.normal(size=(50, 3))])
    q = np.concatenate([rng.integers(0, 3, size=(20, 3)).astype(float), 1e4 + rng.normal(size=(10, 3))])
    tr = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "tid int, v array<double>")
    te = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(999, None)], "qid int, v array<double>")
    got = {}
    for r in J.nearest_neighbour(tr, te, "v", "tid", "qid", n_pivots=3, block_rows=8, k=7).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.tid))
    want = {i: [(n + 1, j) for n, j in enumerate(sorted(range(len(x)), key=lambda j: (np.sqrt(((x[j] - v) ** 2).sum()), j))[:7])] for i, v in enumerate(q)}
    assert {i: sorted(v) for i, v in got.items()} == want
    assert J.nearest_neighbour(tr.filter("tid < 0"), te, "v", "tid", "qid").count() == 0


def test_alignment_raises(spark):
    a, b = spark.createDataFrame([(0, 1), (1, 2)], "row_id int, c int"), spark.createDataFrame([(0, 1, "x"), (1, 3, "y")], "row_id int, c int, s string")
    with pytest.raises(ValueError):
        J.align_by_position(a, b, "row_id", ["c"])
    assert J.align_by_position(a, b.withColumn("c", F.col("row_id") + 1), "row_id", ["c"]).count() == 2


def test_counts_check(spark):
    a = spark.createDataFrame([("m", 1, 2, 3, 4)], "k string, tp long, fp long, fn long, tn long")
    J.assert_counts_equal(a, a, ["k"])
    with pytest.raises(AssertionError):
        J.assert_counts_equal(a, a.withColumn("tp", F.lit(9)), ["k"])


def test_twins_and_bound(spark):
    d = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), (None, 0), (None, 1)], "c string, y int")
    got = sorted((r.c or "", r.y, r.is_copy) for r in A.flag_twins(d, ["c"]).collect())
    assert got == [("", 0, True), ("", 1, False), ("a", 0, True), ("a", 1, False), ("b", 0, False)]
    c = A.conflict_ceiling(spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "c string, y int"), ["c"]).first()
    assert c.ba_ceiling == pytest.approx(0.75) and c.n_conflicting_records == 1 and c.flows_in_conflicting == 2


def test_top_conflicts_and_hosts_text(spark):
    d = spark.createDataFrame([(1.0, 0.0, 0, "f1", "benign"), (1.0, 0.0, 1, "f2", "flood"), (2.0, 0.0, 0, "f1", "benign")], "a double, b double, y int, file string, kind string")
    r = A.top_conflicts(d, ["a", "b"], "file", "kind").collect()
    assert len(r) == 1 and r[0].by_file_and_type == '{"f1|benign":1,"f2|flood":1}' and r[0].nonzero_fields == '{"a":"1.0"}'


def test_files_are_matched(spark):
    d = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (1, "y", 0), (2, "z", 1)], "file int, src string, y int")
    e = d.withColumn("file", F.concat(F.lit("f"), F.col("file").cast("string")))
    assert {r.file_a: r.file_b for r in A.match_files(d, e, "file", "src").collect()} == {1: "f1", 2: "f2"}


def test_group_of_association_extremes(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "g string, y string")
    r = A.association(A.contingency(d, "g", "y")).first()
    assert r.nmi == pytest.approx(1) and r.cramers_v == pytest.approx(1) and r.purity == 1
    one = A.association(A.contingency(d.withColumn("y", F.lit("x")), "g", "y")).first()
    assert one.cramers_v is None and one.purity == 1 and one.nmi == pytest.approx(0)


def test_gini(spark):
    sizes = [1, 1, 2, 5, 11]
    d = spark.createDataFrame([(i,) for i, s in enumerate(sizes) for _ in range(s)], "g int")
    c = A.concentration(d, "g").first()
    n, p = len(sizes), [s / 20 for s in sizes]
    assert c.gini == pytest.approx(sum((2 * (i + 1) - n - 1) * v for i, v in enumerate(p)) / n)
    assert c.top5_share == 1 and c.largest_group_share == 11 / 20
