"""The parts with a streaming shape, on Structured Streaming.

Differences to a batch run over the same rows: rows later than the watermark are dropped,
where a batch sorts them in.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import flows as FL

FLOW_OUT = ("k string, first_ts double, last_ts double, total_pkts long, total_ip_bytes long, fwd_pkts long, fwd_ip_bytes long")


class FlowProcessor(StatefulProcessor):
    """X1. State of fixed size per key: the open flow, and the packets of a short reorder buffer.

    Packets of a micro-batch are sorted and folded. An open flow closes on a packet past the
    idle or active timeout, or when the watermark passes its idle end.
    """

    def __init__(self, idle: float, active: float):
        self.idle, self.active = idle, active

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "first double, last double, pkts long, bytes long, fpkts long, fbytes long, src string")

    def _row(self, key, s) -> dict:
        return dict(k=key, first_ts=s[0], last_ts=s[1], total_pkts=s[2], total_ip_bytes=s[3], fwd_pkts=s[4], fwd_ip_bytes=s[5])

    def _arm(self, last: float) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((last + self.idle) * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = [b for b in rows if len(b)]
        if not got:
            return
        d = pd.concat(got).sort_values(["ts", "seq"])
        s = list(self.flow.get()) if self.flow.exists() else None
        out = []
        for ts, src, n in zip(d["ts"], d["src"], d["ip_len"]):
            if s is not None and (ts - s[0] > self.active or ts - s[1] > self.idle):
                out.append(self._row(key[0], s))
                s = None
            if s is None:
                s = [float(ts), float(ts), 0, 0, 0, 0, src]
            s[1] = max(s[1], float(ts))
            s[2] += 1
            s[3] += int(n)
            if src == s[6]:
                s[4] += 1
                s[5] += int(n)
        self.flow.update(tuple(s))
        self._arm(s[1])
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.flow.exists():
            s = self.flow.get()
            self.flow.clear()
            yield pd.DataFrame([self._row(key[0], s)])

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame, idle: float = FL.IDLE_TIMEOUT_S, active: float = FL.ACTIVE_TIMEOUT_S, delay: str = "0 seconds") -> DataFrame:
    """X1. Flows of an unbounded packet table, by the key text `k` and event time `ts` in seconds.

    Needs the RocksDB state store. A packet may arrive up to `delay` late.
    """
    d = packets.withColumn("et", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("et", delay)
    return d.groupBy("k").transformWithStateInPandas(
        statefulProcessor=FlowProcessor(idle, active), outputStructType=FLOW_OUT, outputMode="Append", timeMode="EventTime")


def stream_sessions(packets: DataFrame, keys: list[str], idle: str = "30 seconds", delay: str = "30 seconds") -> DataFrame:
    """X2. Idle-only sessions by the built-in session window."""
    d = packets.withColumn("et", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("et", delay)
    g = d.groupBy(*keys, F.session_window("et", idle).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def stream_windows(records: DataFrame, keys: list[str], cols: list[str], ts: str = "et", width: str = "16 seconds", slide: str | None = None,
                   delay: str = "16 seconds") -> DataFrame:
    """X3. Tumbling or sliding telemetry windows: records, devices' mean and population sd."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    aggs = [F.count(F.lit(1)).alias("n_records")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_sd")]
    g = records.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(*aggs)
    return g.select(*keys, F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), *[c for c in g.columns if c not in (*keys, "w")])


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame | None:
    got = [b for b in rows if len(b)]
    return pd.concat(got).sort_values(order) if got else None


class RateProcessor(StatefulProcessor):
    """X4. The previous record of each device."""

    def __init__(self, key: str, ts: str, row_id: str, counter: str):
        self.key, self.ts, self.row_id, self.counter = key, ts, row_id, counter

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.prev = handle.getValueState("prev", "us long, c long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = _in_order(rows, [self.ts, self.row_id])
        if d is None:
            return
        d = d.reset_index(drop=True)
        us, c = d[self.ts].astype("int64"), d[self.counter].astype("int64")
        dt, delta = us.diff() / 1e6, c.diff()
        if self.prev.exists():
            us0, c0 = self.prev.get()
            dt.iloc[0], delta.iloc[0] = (us[0] - us0) / 1e6, c[0] - c0
        self.prev.update((int(us.iloc[-1]), int(c.iloc[-1])))
        yield pd.DataFrame({self.key: key[0], self.row_id: d[self.row_id], "rate": (delta.clip(lower=0) / dt).where(dt > 0),
                            "clamped": (delta < 0).astype("int32")})

    def close(self) -> None:
        pass


def _type(d: DataFrame, c: str) -> str:
    return f"`{c}` {d.schema[c].dataType.simpleString()}"


def stream_rates(records: DataFrame, counter: str = "counter", key: str = "user_id", ts: str = "us", row_id: str = "event_id") -> DataFrame:
    """X4. Per-device counter rates with ValueState: records of `key` by (`ts` in microseconds, `row_id`)."""
    d = records.select(key, ts, row_id, counter)
    return d.groupBy(key).transformWithStateInPandas(
        statefulProcessor=RateProcessor(key, ts, row_id, counter), outputStructType=f"{_type(d, key)}, {_type(d, row_id)}, rate double, clamped int",
        outputMode="Append", timeMode="None")


class LatenessProcessor(StatefulProcessor):
    """X6. The latest time seen of each key."""

    def __init__(self, ts: str, arrival: str, delay_us: int, columns: list[str]):
        self.ts, self.arrival, self.delay_us, self.columns = ts, arrival, delay_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = _in_order(rows, [self.arrival])
        if d is None:
            return
        us = d[self.ts].astype("int64").reset_index(drop=True)
        before = self.seen.get()[0] if self.seen.exists() else int(us.iloc[0])
        latest = us.cummax().clip(lower=before)
        self.seen.update((int(latest.iloc[-1]),))
        lag = (latest.shift(1, fill_value=before) - us).clip(lower=0)
        d = d.reset_index(drop=True)[self.columns]
        yield d.assign(lag_us=lag, late=lag > self.delay_us)

    def close(self) -> None:
        pass


def stream_lateness(records: DataFrame, key: str, ts: str, arrival: str, delay_s: float) -> DataFrame:
    """X6. Every record with `lag_us`, how far it lies behind the latest earlier arrival of its key, and `late`.

    Times `ts` are microseconds; `arrival` orders the records of a key as they came and must grow
    from one micro-batch to the next. A record is late when its lag is greater than `delay_s`. Nothing
    is dropped, and how the stream is cut into micro-batches changes nothing. The state is one number
    a key; the records of one key in one micro-batch are held in memory, so bound the micro-batch.
    Records without a time or an arrival cannot be placed: they come out late with a NULL lag.
    A watermark in contrast is one time for all keys. Columns named `lag_us` or `late` are replaced.
    """
    d = records.drop("lag_us", "late")
    placed = F.col(ts).isNotNull() & F.col(arrival).isNotNull()
    types = ", ".join(_type(d, c) for c in d.columns)
    out = d.filter(placed).groupBy(key).transformWithStateInPandas(
        statefulProcessor=LatenessProcessor(ts, arrival, int(delay_s * 1e6), d.columns),
        outputStructType=f"{types}, lag_us long, late boolean", outputMode="Append", timeMode="None")
    return out.unionByName(d.filter(~placed).withColumns({"lag_us": F.lit(None).cast("long"), "late": F.lit(True)}))


def late_sink(path: str, late_path: str) -> Callable[[DataFrame, int], None]:
    """X6. foreachBatch sink of `stream_lateness`: records in time to one path, late ones to another.

    As in `alert_sink`, a batch owns the folder `batch_id=<n>` in both, and a replay writes it anew.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for late, to in ((False, path), (True, late_path)):
                kept.filter(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{to}/batch_id={batch_id}")
        finally:
            kept.unpersist()
    return run


def alert_sink(model, cols: list[str], path: str, tau: float = 0.5, row_id: str = "row_id") -> Callable[[DataFrame, int], None]:
    """X5. foreachBatch sink: score finished windows with a fitted model and write the alerts.

    Each batch has a folder of its own, `batch_id=<n>`, which a replayed batch writes anew, so
    an alert is out once. The id is a column when the path is read.
    """
    from ..operators import models as M

    def run(batch: DataFrame, batch_id: int) -> None:
        s = M.predict_scores(model, batch, row_id).filter(F.col("score") >= tau)
        s.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return run
