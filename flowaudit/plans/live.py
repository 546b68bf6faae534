"""Streaming queries, run to completion over the driver's events as a file stream."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import operators as ST
from . import telemetry as T
from .registry import query, r6

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _work_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for a stream's checkpoint and output, on the shared path where one is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"flowaudit-{name}-")


def run_available(df: DataFrame, name: str, mode: str = "append", rocks: bool = False) -> DataFrame:
    """Drain a stream into a Parquet folder and read it back."""
    spark = df.sparkSession
    path = _work_dir(spark, name)
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    if rocks:
        spark.conf.set(key, ROCKS)
    try:
        q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option(
            "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if rocks and old:
            spark.conf.set(key, old)
        elif rocks:
            spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _like_events(df: DataFrame) -> DataFrame:
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return df.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("ts").cast("timestamp").alias("et"), "user_id", "value",
                     cents.alias("cents"), F.pmod(F.col("event_id") * 977 + cents, F.lit(100000)).alias("counter"))


@query("stream_rates", f"""WITH {T.EV}, l AS (SELECT *, lag(counter) OVER w AS pc, (us - lag(us) OVER w) / 1e6 AS dt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, event_id, round(CASE WHEN dt > 0 THEN greatest(counter - pc, 0) / dt END, 6) AS rate, coalesce((counter < pc)::INT, 0) AS clamped FROM l""")
def stream_rates(spark, d):
    """Equal to the batch counter rates; a test compares the two."""
    return r6(run_available(ST.stream_rates(_like_events(_event_stream(spark, d))), "rates", rocks=True))


@query("stream_lateness", f"""WITH {T.EV}, a AS (SELECT user_id, us, max(us) OVER (PARTITION BY user_id ORDER BY event_id + event_id * 7919 % 1000, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ev), l AS (SELECT user_id, greatest(coalesce(seen - us, 0), 0) AS lag_us FROM a)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE lag_us > 0) AS n_behind, count(*) FILTER (WHERE lag_us > 86400000000) AS n_late, max(lag_us) AS max_lag_us FROM l GROUP BY user_id""")
def stream_lateness(spark, d):
    """Events held up by up to 1,000 others, late when a day behind the latest of their device."""
    e = _like_events(_event_stream(spark, d)).select("user_id", "us", ((F.col("event_id") + F.col("event_id") * 7919 % 1000) * 1_000_000_000 + F.col("event_id")).alias("arrival"))
    r = run_available(ST.stream_lateness(e, "user_id", "us", "arrival", 86400), "late", rocks=True)
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lag_us") > 0).alias("n_behind"), F.count_if("late").alias("n_late"), F.max("lag_us").alias("max_lag_us"))


@query("stream_windows", f"""WITH {T.EV}, b AS (SELECT user_id % 5 AS k, us, value FROM ev), w AS (SELECT k, us // 3600000000 * 3600000000 AS win_start, count(*) AS n_records, avg(value) AS m, stddev_pop(value) AS sd FROM b GROUP BY ALL)
SELECT k, win_start, n_records, round(m, 6) AS value_mean, round(sd, 6) AS value_sd FROM w WHERE win_start + 3600000000 <= (SELECT max(us) FROM ev)""")
def stream_windows(spark, d):
    """Hourly windows by device block; a window is out once the watermark has passed it."""
    s = _like_events(_event_stream(spark, d)).withColumn("k", F.pmod("user_id", F.lit(5)))
    w = run_available(ST.stream_windows(s, ["k"], ["value"], width="1 hour", delay="0 seconds"), "windows")
    return r6(w.select("k", F.unix_micros("win_start").alias("win_start"), "n_records", "value_mean", "value_sd"))


@query("stream_flows")
def stream_flows(spark, d):
    """Flows still open at the end of the stream are not out yet; a test compares the others with the batch."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    e = _like_events(raw)
    out = F.pmod("event_id", F.lit(3)) != 0
    p = e.select(F.col("user_id").cast("string").alias("k"), (F.col("us") / 1e6).alias("ts"), F.col("event_id").alias("seq"),
                 F.when(out, "client").otherwise("server").alias("src"), (F.lit(40) + F.pmod("cents", F.lit(1460))).cast("int").alias("ip_len"))
    return r6(run_available(ST.stream_flows(p, T.IDLE, T.ACTIVE), "flows", rocks=True))


@query("stream_sessions", f"""WITH {T.PK}, s AS (SELECT user_id, episode, count(*) AS n, round(min(ts), 6) AS first_ts, round(max(ts), 6) AS last_ts FROM ep GROUP BY user_id, episode)
SELECT user_id, n, first_ts, last_ts FROM s WHERE last_ts + 21600e0 <= (SELECT max(ts) FROM pk)""")
def stream_sessions(spark, d):
    """X2."""
    e = _like_events(_event_stream(spark, d)).withColumn("ts", F.col("us") / 1e6).drop("et")
    return r6(run_available(ST.stream_sessions(e, ["user_id"], "21600 seconds", "0 seconds"), "sessions"))
