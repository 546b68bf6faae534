import pytest
from pyspark.sql import functions as F

from flowaudit.operators import sessions as W

S = 1_000_000


def test_gap_is_strict(spark):
    d = spark.createDataFrame([(0,), (300 * S,), (600 * S + 1,)], "us long")
    got = [r.session for r in W.sessionize(d, "us", 300 * S).orderBy("us").collect()]
    assert got == [0, 0, 1]


@pytest.mark.parametrize("gap", [7, 50, 113])
def test_sessions_against_a_plain_loop(spark, gap):
    import random
    r = random.Random(gap)
    ts = sorted(r.randrange(0, 20_000) for _ in range(600))
    want, s = [], 0
    for i, t in enumerate(ts):
        s += i > 0 and t - ts[i - 1] > gap
        want.append(s)
    d = spark.createDataFrame([(t,) for t in ts], "us long").repartition(7)
    assert [x.session for x in W.sessionize(d, "us", gap).orderBy("us").collect()] == want


def test_counter_reset_is_clamped(spark):
    d = spark.createDataFrame([(1, 0, 100), (1, S, 250), (1, 2 * S, 40), (1, 2 * S, 50)], "ue int, us long, c long")
    r = W.counter_rates(d, "ue", "us", ["c"], ["c"], bucket_us=S).orderBy("us", "c").collect()
    assert [(x.c_rate, x.c_clamped) for x in r] == [(None, 0), (150.0, 0), (0.0, 1), (None, 0)]


def test_short_tail_is_dropped(spark):
    d = spark.range(35).select(F.lit(1).alias("g"), (F.col("id") * S).alias("us"))
    w = W.record_windows(d, ["g"], "us", bucket_us=5 * S)
    assert w.count() == 32 and sorted({x.w for x in w.collect()}) == [0, 1]
    assert sorted((x.w, x.pos) for x in w.collect()) == [(i // 16, i % 16) for i in range(32)]
    a = W.window_accounting(d, ["g"]).first()
    assert (a.complete_windows, a.records_dropped) == (2, 3)


def test_two_standard_deviations(spark):
    d = spark.createDataFrame([(1, 0, 1.0, "a", 0), (1, 0, 3.0, "b", 1)], "g int, w int, v double, lab string, y int").withColumn("idx", F.lit(0))
    f = W.window_features(d, ["g"], ["v"], "lab", "y").first()
    assert f.v_std == pytest.approx(1.41421, abs=1e-4) and f.category == "a" and f.y == 1
    n = W.layer_aggregate(d, ["g"], ["v"], "radio", "n").first()
    assert n.radio_v_sd == 1.0 and n.radio_v_sum == 4.0


def test_grid(spark):
    d = spark.createDataFrame([(1, 0.0, 33.0), (2, 5.0, 5.0)], "run int, t0 double, t1 double")
    g = W.window_grid(d, ["run"], "t0", "t1", 16.0, 16.0)
    assert sorted((r.run, r.win_start) for r in g.collect()) == [(1, 0.0), (1, 16.0), (1, 32.0), (2, 5.0)]


def test_overlapping_grid_assigns_every_covering_window(spark):
    sp = spark.createDataFrame([(1, 0.0, 40.0)], "run int, lo double, hi double")
    d = spark.createDataFrame([(1, 9.0), (1, 3.0), (1, 39.0)], "run int, t double")
    got = sorted((r.t, r.idx) for r in W.to_grid(d, sp, ["run"], "t", 16.0, 8.0).collect())
    assert got == [(3.0, 0), (9.0, 0), (9.0, 1), (39.0, 3)]


@pytest.mark.parametrize("bucket", [1, 2, 100])
def test_capture_files(spark, bucket):
    d = spark.createDataFrame(list(enumerate([0, 10, 20, 5, 8, 1])), "row_id long, off long")
    assert [r.file for r in W.capture_files(d, "row_id", "off", bucket).orderBy("row_id").collect()] == [1, 1, 1, 2, 2, 3]


def test_sequences_keep_order_and_fill(spark):
    d = spark.createDataFrame([(1, 2 * S, 3.0), (1, S, None), (1, 3 * S, 5.0)], "g int, us long, v double").withColumn("y", F.lit(0))
    w = W.record_windows(d, ["g"], "us", size=3)
    assert W.window_sequences(w, ["g"], ["v"], "y").first().seq == [[0.0], [3.0], [5.0]]
