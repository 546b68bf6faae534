import os

from pyspark.sql import functions as F

from flowaudit.operators import flows as FL
from flowaudit.operators import models as M
from flowaudit.plans import bindings as X
from flowaudit.plans import live
from flowaudit.plans import telemetry as T
from flowaudit.plans.catalog import QUERIES
from flowaudit.streaming import operators as ST


def test_rates_equal_the_batch(spark, data):
    a = {r.event_id: (r.rate, r.clamped) for r in QUERIES["stream_rates"](spark, data).collect()}
    b = {r.event_id: (r.counter_rate, r.counter_clamped) for r in QUERIES["counter_rates"](spark, data).collect()}
    assert a == b


def test_closed_flows_equal_the_batch(spark, data):
    got = {(r.k, r.first_ts): (r.total_pkts, r.total_ip_bytes) for r in QUERIES["stream_flows"](spark, data).collect()}
    p = X.packets(spark, data)
    v = FL.flow_volumes(FL.assign_flows(p, ["user_id"], "ts", T.IDLE, T.ACTIVE), ["user_id", "episode", "seg"])
    want = {(str(r.user_id), round(r.first_ts, 6)): (r.total_pkts, r.total_ip_bytes) for r in v.collect()}
    assert all(want[k] == n for k, n in got.items()) and len(got) > 0.9 * len(want)
    end = p.agg(F.max("ts")).first()[0]
    open_ones = [k for k in want if k not in got]
    last = {(str(r.user_id), round(r.first_ts, 6)): r.last_ts for r in v.collect()}
    assert all(last[k] + T.IDLE >= end - 1 for k in open_ones)


def test_alert_loop(spark, data, tmp_path):
    w = QUERIES["window_features"](spark, data).select(F.concat_ws("-", F.col("user_id"), F.col("w")).alias("row_id"), "y", "value_mean", "value_std").na.fill(0.0)
    model = M.fit_model(M.BY_KEY["tree"], w, ["value_mean", "value_std"])
    w.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(w.schema).parquet(str(tmp_path / "in"))
    from flowaudit.streaming.operators import alert_sink
    q = s.writeStream.foreachBatch(alert_sink(model, ["value_mean"], str(tmp_path / "alerts"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = M.predict_scores(model, w).filter("score >= 0.5").count()
    assert want > 0 and spark.read.parquet(str(tmp_path / "alerts")).count() == want
    sink = alert_sink(model, ["value_mean"], str(tmp_path / "alerts"))
    for _ in range(2):                                       # a batch that is replayed is written anew
        sink(w, 0)
    again = spark.read.parquet(str(tmp_path / "alerts"))
    assert again.count() == want and again.filter("batch_id = 0").count() == want
    assert live.ROCKS.endswith("RocksDBStateStoreProvider")


def test_late_rows_go_to_the_side_and_none_is_lost(spark, tmp_path):
    """Three files, one a micro-batch: lags reach back over batches, and a replay writes a batch anew."""
    files = [[("a", 0, 100), ("a", 1, 90), ("b", 2, 5)], [("a", 3, 95), ("a", 4, 200), ("a", 5, 199), ("b", 6, 5)], [("a", 7, 120), ("b", 8, None), ("b", 9, 1), (None, 10, 4)]]
    schema = "k string, seq long, us long"
    for i, f in enumerate(files):
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for n, p in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)):
            if n == i:
                os.utime(p, (1_000_000 + i, 1_000_000 + i))
    batches = {}
    sink = ST.late_sink(str(tmp_path / "ok"), str(tmp_path / "late"))

    def keep(batch, n):
        sink(batch, n)
        batches[n] = batch.collect()
        sink(spark.createDataFrame(batches[n], batch.schema), n)                    # replayed

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.ROCKS)
    try:
        q = ST.stream_lateness(s.withColumn("lag_us", F.lit(7)), "k", "us", "seq", 9e-6).writeStream.foreachBatch(keep).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    ok = {r.seq: r.lag_us for r in spark.read.parquet(str(tmp_path / "ok")).collect()}
    late = {r.seq: r.lag_us for r in spark.read.parquet(str(tmp_path / "late")).collect()}
    assert ok == {0: 0, 2: 0, 3: 5, 4: 0, 5: 1, 6: 0, 9: 4, 10: 0}
    assert late == {1: 10, 7: 80, 8: None}
    assert sum(len(b) for b in batches.values()) == 11


def test_rates_with_other_column_names(spark, tmp_path):
    rows = [("x", 0, 1, 10), ("x", 2_000_000, 2, 14), ("x", 2_000_000, 3, 20), ("x", 3_000_000, 4, 5), ("y", 0, 5, 1)]
    spark.createDataFrame(rows, "dev string, t long, id int, c int").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("dev string, t long, id int, c int").parquet(str(tmp_path / "in"))
    got = {r.id: (r.dev, r.rate, r.clamped) for r in live.run_available(ST.stream_rates(s, "c", "dev", "t", "id"), "r", rocks=True).collect()}
    assert got == {1: ("x", None, 0), 2: ("x", 2.0, 0), 3: ("x", None, 0), 4: ("x", 0.0, 1), 5: ("y", None, 0)}
