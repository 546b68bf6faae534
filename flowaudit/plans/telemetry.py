"""Queries over telemetry and packets: sessions, windows, counters, grids, flows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import flows as FL
from ..operators import joins as J
from ..operators import sessions as W
from ..operators import splits as D
from . import bindings as X
from .registry import query, r6, u

GAP = 900_000_000            # 900 s: the driver's events are hours apart per user
GAPS = [300_000_000, 900_000_000, 1_200_000_000]
EV = """ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, (event_type = 'error')::INT AS y,
  floor(value * 100 + 0.5e0)::BIGINT AS cents, (event_id * 977 + floor(value * 100 + 0.5e0)::BIGINT) % 100000 AS counter FROM events)"""


def sess_sql(gap: int, src: str = "ev", out: str = "s") -> str:
    return f"""{out}0 AS (SELECT *, us - lag(us) OVER (ORDER BY us, event_id) AS gap FROM {src}),
{out} AS (SELECT *, sum((coalesce(gap, 0) > {gap})::INT) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM {out}0)"""


SESS = EV + ", " + sess_sql(GAP)


def _sessions(spark, d):
    return W.sessionize(X.events(spark, d), "us", GAP)


@query("telemetry_sessions", f"""WITH {SESS}, m AS (SELECT session, event_type, count(*) AS c FROM s GROUP BY session, event_type),
md AS (SELECT session, arg_min(event_type, (-c, event_type)) AS category FROM m GROUP BY session)
SELECT session, count(*) AS n, min(us) AS start_us, max(us) AS end_us, count(DISTINCT event_type) AS n_categories, max(category) AS category,
  round(avg(y), 6) AS attack_share, count(DISTINCT user_id) AS n_ues, (count(DISTINCT event_type) = 1)::INT AS label_pure FROM s JOIN md USING (session) GROUP BY session""")
def telemetry_sessions(spark, d):
    """W1, W3, A5."""
    return r6(W.session_summary(_sessions(spark, d), "us", "event_type", "y", "user_id"))


@query("session_rule_sweep", f"""WITH {EV}, {', '.join(sess_sql(g, 'ev', f'g{i}') for i, g in enumerate(GAPS))},
u AS ({' UNION ALL '.join(f"SELECT {g} AS gap_us, a.session, a.event_type, a.user_id, r.session AS ref FROM g{i} a JOIN g1 r USING (event_id)" for i, g in enumerate(GAPS))}),
p AS (SELECT gap_us, session, count(DISTINCT event_type) AS n1, count(DISTINCT user_id) AS n2, count(DISTINCT ref) AS nr FROM u GROUP BY gap_us, session)
SELECT gap_us::BIGINT AS gap_us, count(*) AS n_segments, count(*) FILTER (WHERE n1 = 1) AS n_category_pure, count(*) FILTER (WHERE n2 = 1) AS n_subcategory_pure,
  CASE WHEN gap_us <= {GAP} THEN (max(nr) = 1)::INT END AS nested_in_reference FROM p GROUP BY gap_us""")
def session_rule_sweep(spark, d):
    """W2, W19."""
    return W.session_rule_sweep(X.events(spark, d), "us", GAPS, GAP, "event_type", "user_id")


@query("session_timeline", f"""WITH {SESS} SELECT session, count(*) AS n, round((max(us) - min(us)) / 60e6, 6) AS duration_min,
  round((min(us) - (SELECT min(us) FROM s)) / 86400e6, 6) AS day FROM s GROUP BY session""")
def session_timeline(spark, d):
    """W15."""
    t = W.session_timeline(_sessions(spark, d), "us", "event_type", "y", "user_id")
    return r6(t.select("session", "n", "duration_min", "day"))


@query("session_window_map", f"""WITH {SESS}, c AS (SELECT session, event_type, count(*) AS n FROM s GROUP BY session, event_type),
f AS (SELECT session, arg_min(event_type, (-n, event_type)) AS category, sum(n)::BIGINT AS n, count(*) AS k FROM c GROUP BY session)
SELECT session, category, n AS n_windows, (k = 1)::INT AS agree FROM f""")
def session_window_map(spark, d):
    """J21."""
    s = _sessions(spark, d)
    counts = s.groupBy("session", F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("n_windows"))
    return W.session_map(W.session_summary(s, "us", "event_type").select("session", "category"), counts)


@query("gap_statistics", f"""WITH {EV}, g AS (SELECT (us - lag(us) OVER (ORDER BY us)) / 1e6 AS g, us FROM ev)
SELECT round(quantile_cont(g, 0.5), 6) AS median_gap_s, round(quantile_cont(g, 0.95), 6) AS p95_gap_s, round(quantile_cont(g, 0.99), 6) AS p99_gap_s, round(max(g), 6) AS max_gap_s,
  round(1e0 / quantile_cont(g, 0.5), 6) AS implied_hz, round((max(us) - min(us)) / 1e6 / 86400e0, 6) AS span_days FROM g""")
def gap_statistics(spark, d):
    """A4."""
    return r6(W.gap_statistics(X.events(spark, d), "us"))


@query("counter_rates", f"""WITH {EV}, l AS (SELECT *, lag(counter) OVER w AS pc, (us - lag(us) OVER w) / 1e6 AS dt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, user_id, round(CASE WHEN dt > 0 THEN greatest(counter - pc, 0) / dt END, 6) AS counter_rate, coalesce((counter < pc)::INT, 0) AS counter_clamped FROM l""")
def counter_rates(spark, d):
    """W4, W5."""
    r = W.counter_rates(X.events(spark, d), "user_id", "us", ["counter"], ["event_id"])
    return r6(r.select("event_id", "user_id", "counter_rate", "counter_clamped"))


RW = f"""{EV}, rn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
win AS (SELECT *, rn // 16 AS w, rn % 16 AS pos FROM rn WHERE rn < n // 16 * 16)"""


def _windows(spark, d):
    return W.record_windows(X.events(spark, d), ["user_id"], "us", ["event_id"])


@query("record_windows", f"WITH {RW} SELECT event_id, user_id, w::BIGINT AS w, pos::INT AS pos FROM win")
def record_windows(spark, d):
    """W7."""
    return _windows(spark, d).select("event_id", "user_id", "w", "pos")


@query("window_accounting", f"""WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id)
SELECT count(*) AS n_groups, count(*) FILTER (WHERE n >= 16) AS groups_with_enough, sum(n // 16)::BIGINT AS complete_windows, sum(n)::BIGINT AS n_records,
  (sum(n) - sum(n // 16) * 16)::BIGINT AS records_dropped, round(100e0 * (sum(n) - sum(n // 16) * 16) / sum(n), 6) AS drop_rate_pct FROM n""")
def window_accounting(spark, d):
    """W7, accounting form."""
    return r6(W.window_accounting(X.events(spark, d), ["user_id"]))


@query("window_features", f"""WITH {RW}, m AS (SELECT user_id, w, event_type, count(*) AS c FROM win GROUP BY ALL), md AS (SELECT user_id, w, arg_min(event_type, (-c, event_type)) AS category FROM m GROUP BY ALL)
SELECT user_id, w::BIGINT AS w, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, round(avg(counter), 6) AS counter_mean, round(stddev_samp(counter), 6) AS counter_std,
  max(category) AS category, max(y) AS y FROM win JOIN md USING (user_id, w) GROUP BY user_id, w""")
def window_features(spark, d):
    """A6."""
    return r6(W.window_features(_windows(spark, d), ["user_id"], ["value", "counter"], "event_type", "y"))


@query("window_sequences", f"""WITH {RW} SELECT user_id, w::BIGINT AS w, string_agg(cents::VARCHAR || ':' || counter::VARCHAR, ',' ORDER BY pos) AS seq, max(y) AS y FROM win GROUP BY user_id, w""")
def window_sequences(spark, d):
    """W8."""
    s = W.window_sequences(_windows(spark, d), ["user_id"], ["cents", "counter"], "y")
    text = F.transform("seq", lambda v: F.concat_ws(":", v[0].cast("long").cast("string"), v[1].cast("long").cast("string")))
    return s.select("user_id", "w", F.array_join(text, ",").alias("seq"), "y")


@query("window_grid", f"""WITH {EV}, sp AS (SELECT event_type, min(us) / 1e6 AS t0, max(us) / 1e6 AS t1 FROM ev GROUP BY event_type)
SELECT event_type, idx::INT AS idx, round(t0 + idx * 43200e0, 6) AS win_start, round(t0 + idx * 43200e0 + 86400e0, 6) AS win_end
FROM (SELECT *, unnest(range(greatest(ceil((t1 - t0) / 43200e0), 1)::BIGINT)) AS idx FROM sp)""")
def window_grid(spark, d):
    """W9, overlapping windows."""
    sp = X.events(spark, d).groupBy("event_type").agg((F.min("us") / 1e6).alias("t0"), (F.max("us") / 1e6).alias("t1"))
    return r6(W.window_grid(sp, ["event_type"], "t0", "t1", 86400.0, 43200.0))


# two layers over the same runs: a run is one user block, clicks are flows and the rest telemetry
LAY = f"""{EV}, a AS (SELECT user_id % 10 AS run, us / 1e6 AS t, value, cents, user_id FROM ev WHERE event_type IN ('click', 'error')),
b AS (SELECT user_id % 10 AS run, us / 1e6 AS t, value, user_id FROM ev WHERE event_type NOT IN ('click', 'error')),
sp AS (SELECT run, a_lo, a_hi, b_lo, b_hi, greatest(a_lo, b_lo) AS lo, least(a_hi, b_hi) AS hi FROM (SELECT run, min(t) AS a_lo, max(t) AS a_hi FROM a GROUP BY run) JOIN (SELECT run, min(t) AS b_lo, max(t) AS b_hi FROM b GROUP BY run) USING (run)),
ga AS (SELECT a.*, floor((t - lo) / 21600e0)::INT AS idx FROM a JOIN sp USING (run) WHERE t >= lo AND t < lo + floor((t - lo) / 21600e0)::INT * 21600e0 + 21600e0 AND lo + floor((t - lo) / 21600e0)::INT * 21600e0 + 21600e0 <= hi),
gb AS (SELECT b.*, floor((t - lo) / 21600e0)::INT AS idx FROM b JOIN sp USING (run) WHERE t >= lo AND t < lo + floor((t - lo) / 21600e0)::INT * 21600e0 + 21600e0 AND lo + floor((t - lo) / 21600e0)::INT * 21600e0 + 21600e0 <= hi),
na AS (SELECT run, idx, count(*) AS net_n_flows, count(DISTINCT user_id) AS net_n_src_ips, avg(ln(1 + value)) AS m, stddev_pop(ln(1 + value)) AS sd, sum(ln(1 + value)) AS sm FROM ga GROUP BY run, idx),
nb AS (SELECT run, idx, count(*) AS radio_n_records, count(DISTINCT user_id) AS radio_n_ues, avg(value) AS m, stddev_pop(value) AS sd FROM gb GROUP BY run, idx)"""
STEP = 21600.0


def _layers(spark, d):
    e = X.events(spark, d).withColumn("run", F.pmod("user_id", F.lit(10))).withColumn("t", F.col("us") / 1e6)
    a = e.filter(F.col("event_type").isin("click", "error"))
    b = e.filter(~F.col("event_type").isin("click", "error"))
    sp = W.overlap_window(a, b, ["run"], "t", "t", "t")
    na = W.layer_aggregate(W.to_grid(a, sp, ["run"], "t", STEP, STEP), ["run"], ["value"], "net", "n_flows", {"n_src_ips": "user_id"}, ["value"])
    nb = W.layer_aggregate(W.to_grid(b, sp, ["run"], "t", STEP, STEP), ["run"], ["value"], "radio", "n_records", {"n_ues": "user_id"}, sums=False)
    return na, nb, sp


@query("window_join", f"""WITH {LAY} SELECT run, idx, net_n_flows, net_n_src_ips, round(na.m, 6) AS net_value_mean, round(na.sd, 6) AS net_value_sd, round(na.sm, 6) AS net_value_sum,
  radio_n_records, radio_n_ues, round(nb.m, 6) AS radio_value_mean, round(nb.sd, 6) AS radio_value_sd FROM na JOIN nb USING (run, idx)""")
def window_join(spark, d):
    """J6, W10, A7, A8, P29."""
    na, nb, _ = _layers(spark, d)
    return r6(W.window_join(na, nb, ["run"]))


@query("join_stats", f"""WITH {LAY}, j AS (SELECT run, count(*) FILTER (WHERE na.net_n_flows IS NOT NULL AND nb.radio_n_records IS NOT NULL) AS windows_joined, count(*) FILTER (WHERE nb.radio_n_records IS NULL) AS windows_network_only,
  count(*) FILTER (WHERE na.net_n_flows IS NULL) AS windows_radio_only FROM na FULL JOIN nb USING (run, idx) GROUP BY run)
SELECT run, round(hi - lo, 6) AS overlap_s, round((hi - lo) / (greatest(a_hi, b_hi) - least(a_lo, b_lo)), 6) AS overlap_fraction, round(a_lo - b_lo, 6) AS start_offset_s,
  greatest(ceil((hi - lo) / 21600e0), 1)::BIGINT AS windows_in_grid, windows_joined, windows_network_only, windows_radio_only, round(windows_joined / greatest(ceil((hi - lo) / 21600e0), 1), 6) AS join_rate
FROM sp JOIN j USING (run)""")
def join_stats(spark, d):
    """A59."""
    na, nb, sp = _layers(spark, d)
    s = W.join_stats(na, nb, sp, ["run"], STEP, STEP)
    return r6(s.select("run", "overlap_s", "overlap_fraction", "start_offset_s", "windows_in_grid", "windows_joined", "windows_network_only",
                       "windows_radio_only", "join_rate"))


@query("capture_files", """WITH l AS (SELECT l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS rid, l_linenumber FROM lineitem),
o AS (SELECT rid, max(l_linenumber) AS off FROM l GROUP BY rid), f AS (SELECT rid, (off < lag(off) OVER (ORDER BY rid))::INT AS fall FROM o),
c AS (SELECT rid, sum(coalesce(fall, 0)) OVER (ORDER BY rid ROWS UNBOUNDED PRECEDING) + 1 AS "file" FROM f)
SELECT "file"::BIGINT AS "file", count(*) AS n, min(rid) AS first_row FROM c GROUP BY "file\"""")
def capture_files(spark, d):
    """Rows in order key order, the line number as the offset."""
    l = X.table(spark, d, "lineitem").select((F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("rid"),
                                              "l_linenumber")
    o = l.groupBy("rid").agg(F.max("l_linenumber").alias("off"))
    f = W.capture_files(o, "rid", "off", bucket_rows=1_000_000_000)
    return f.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_row"))


# -------------------------------------------------------------------- flows
IDLE, ACTIVE = 21600.0, 86400.0
PK = f"""{EV}, pk AS (SELECT us / 1e6 AS ts, event_id AS seq, user_id, event_id % 3 <> 0 AS outw, (40 + cents % 1460)::INT AS ip_len, (cents % 1460)::INT AS payload_len, (64 - user_id % 4)::INT AS ttl,
  CASE WHEN user_id % 2 = 0 THEN 6 ELSE 17 END AS proto, CASE WHEN user_id % 2 = 0 THEN ([2, 18, 16, 24, 17])[(event_id % 5) + 1] ELSE 0 END AS flags FROM ev),
ep0 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) AS gap FROM pk),
ep AS (SELECT *, sum((coalesce(gap, 0) > 21600e0)::INT) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::INT AS episode FROM ep0)"""
SEG = f"""WITH RECURSIVE {PK}, n0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, episode ORDER BY ts, seq) AS rn FROM ep),
fold AS (SELECT user_id, episode, rn, ts, seq, ts AS start, 0 AS seg FROM n0 WHERE rn = 1
  UNION ALL SELECT n.user_id, n.episode, n.rn, n.ts, n.seq, CASE WHEN n.ts > f.start + 86400e0 THEN n.ts ELSE f.start END, CASE WHEN n.ts > f.start + 86400e0 THEN f.seg + 1 ELSE f.seg END
  FROM fold f JOIN n0 n ON n.user_id = f.user_id AND n.episode = f.episode AND n.rn = f.rn + 1),
fl AS (SELECT ep.*, fold.seg FROM ep JOIN fold USING (user_id, episode, seq))"""


@query("idle_flows", f"""WITH {PK} SELECT user_id, episode, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_packets FROM ep GROUP BY user_id, episode""")
def idle_flows(spark, d):
    """W12."""
    return FL.idle_episodes(X.packets(spark, d), ["user_id"], "ts", IDLE)


@query("active_flows", f"""{SEG} SELECT user_id, episode, seg::INT AS seg, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM fl GROUP BY user_id, episode, seg""")
def active_flows(spark, d):
    """W13."""
    a = FL.assign_flows(X.packets(spark, d), ["user_id"], "ts", IDLE, ACTIVE)
    return a.groupBy("user_id", "episode", "seg").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _agg(name: str, e: str, places: int = 6) -> str:
    if places == 4:          # times have six decimals: stay clear of rounding ties
        return f"floor(coalesce({e}, 0) * 1e4 + 0.501e0) / 1e4 AS {name}"
    return f"round(coalesce({e}, 0), {places}) AS {name}"


@query("flow_features", f"""{SEG}, dr AS (SELECT *, outw = first_value(outw) OVER w AS fwd, ts - lag(ts) OVER w AS iat FROM fl WINDOW w AS (PARTITION BY user_id, episode, seg ORDER BY ts, seq)),
di AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, episode, seg, fwd ORDER BY ts, seq) AS diat FROM dr)
SELECT round(min(ts), 6) AS first_ts, arg_min(CASE WHEN outw THEN '10.0.0.' || user_id ELSE '10.1.0.1' END, (ts, seq)) AS src_ip, max(proto) AS proto, round(max(ts) - min(ts), 6) AS duration,
  count(*) FILTER (WHERE fwd) AS fwd_pkts, count(*) FILTER (WHERE NOT fwd) AS bwd_pkts, coalesce(sum(payload_len) FILTER (WHERE fwd), 0)::BIGINT AS fwd_bytes, coalesce(sum(ip_len) FILTER (WHERE NOT fwd), 0)::BIGINT AS bwd_ip_bytes,
  {_agg('pkts_per_s', 'count(*) / nullif(max(ts) - min(ts), 0)')}, round(coalesce(sum(payload_len) FILTER (WHERE fwd), 0) / (coalesce(sum(payload_len) FILTER (WHERE NOT fwd), 0) + 1e0), 6) AS bytes_ratio,
  {_agg('iat_mean', 'avg(iat)', 4)}, {_agg('iat_std', 'stddev_pop(iat)', 4)}, {_agg('iat_min', 'min(iat)', 4)}, {_agg('iat_max', 'max(iat)', 4)}, {_agg('fwd_iat_mean', 'avg(diat) FILTER (WHERE fwd)', 4)}, {_agg('bwd_iat_std', 'stddev_pop(diat) FILTER (WHERE NOT fwd)', 4)},
  {_agg('pkt_size_mean', 'avg(ip_len)')}, {_agg('pkt_size_std', 'stddev_pop(ip_len)')}, {_agg('ttl_mean', 'avg(ttl)')},
  count(*) FILTER (WHERE proto = 6 AND flags & 2 = 2) AS flag_syn, count(*) FILTER (WHERE proto = 6 AND flags & 16 = 16) AS flag_ack, count(*) FILTER (WHERE proto = 6 AND flags & 1 = 1) AS flag_fin,
  (max((proto = 6 AND flags & 18 = 2)::INT) * max((proto = 6 AND flags & 18 = 18)::INT))::INT AS handshake_complete
FROM di GROUP BY user_id, episode, seg""")
def flow_features(spark, d):
    """A9, W11, W14, P27, P30."""
    f = FL.flow_features(X.packets(spark, d), IDLE, ACTIVE)
    four = ("iat_mean", "iat_std", "iat_min", "iat_max", "fwd_iat_mean", "bwd_iat_std")
    cols = ["first_ts", "src_ip", "proto", "duration", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_ip_bytes", "pkts_per_s", "bytes_ratio", *four,
            "pkt_size_mean", "pkt_size_std", "ttl_mean", "flag_syn", "flag_ack", "flag_fin", "handshake_complete"]
    off_tie = lambda c: (F.floor(F.col(c) * 1e4 + 0.501) / 1e4).alias(c)                # noqa: E731
    exact = f.select(*[off_tie(c) if c in four else F.col(c) for c in cols])
    return exact.select(*[F.round(c, 6).alias(c) if t == "double" and c not in four else F.col(c) for c, t in exact.dtypes])


@query("flow_volumes", f"""{SEG}, dr AS (SELECT *, outw = first_value(outw) OVER (PARTITION BY user_id, episode, seg ORDER BY ts, seq) AS fwd FROM fl)
SELECT user_id, episode, seg::INT AS seg, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS total_pkts, sum(ip_len)::BIGINT AS total_ip_bytes, count(*) FILTER (WHERE fwd) AS fwd_pkts,
  coalesce(sum(ip_len) FILTER (WHERE fwd), 0)::BIGINT AS fwd_ip_bytes, count(*) FILTER (WHERE NOT fwd) AS bwd_pkts, coalesce(sum(ip_len) FILTER (WHERE NOT fwd), 0)::BIGINT AS bwd_ip_bytes, round(max(ts) - min(ts), 6) AS duration
FROM dr GROUP BY user_id, episode, seg""")
def flow_volumes(spark, d):
    """A10."""
    fk = ["user_id", "episode", "seg"]
    v = FL.flow_volumes(FL.assign_flows(X.packets(spark, d), ["user_id"], "ts", IDLE, ACTIVE), fk)
    return v.withColumn("duration", F.round("duration", 6))


@query("compare_flow_tables", f"""WITH {PK}, a AS (SELECT user_id, count(*) AS p, sum(ip_len) AS b FROM pk GROUP BY user_id), b AS (SELECT user_id, count(*) AS p, sum(ip_len) AS b FROM pk WHERE event_id_mod GROUP BY user_id),
j AS (SELECT coalesce(a.p, 0) AS pa, coalesce(b.p, 0) AS pb, coalesce(a.b, 0) AS ba, coalesce(b.b, 0) AS bb FROM a FULL JOIN b USING (user_id))
SELECT count(*) FILTER (WHERE pb = 0) AS n_keys_a_only, count(*) FILTER (WHERE pa = 0) AS n_keys_b_only, count(*) FILTER (WHERE pa > 0 AND pb > 0) AS n_keys_both, count(*) FILTER (WHERE pa > 0 AND pb > 0 AND pa <> pb) AS n_pkt_mismatch,
  count(*) FILTER (WHERE pa > 0 AND pb > 0 AND ba <> bb) AS n_byte_mismatch, sum(pa)::BIGINT AS total_pkts_a, sum(pb)::BIGINT AS total_pkts_b,
  (count(*) FILTER (WHERE pb = 0 OR pa = 0 OR pa <> pb OR ba <> bb) = 0)::INT AS agrees FROM j""".replace("event_id_mod", "payload_len >= 20"))
def compare_flow_tables(spark, d):
    """The packet table against one without its small packets."""
    p = X.packets(spark, d)
    tot = lambda x: x.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_pkts"), F.sum("ip_len").alias("total_ip_bytes"))
    return FL.compare_flow_tables(tot(p), tot(p.filter("payload_len >= 20")), ["user_id"])


@query("capture_info", f"""WITH {PK}, m AS (SELECT proto, ip_len, count(*) AS c FROM pk GROUP BY ALL), md AS (SELECT proto, arg_min(ip_len, (-c, ip_len)) AS md FROM m GROUP BY proto)
SELECT proto, count(*) AS packets, min(ts) AS first_ts, max(ts) AS last_ts, array_to_string(list_sort(list(DISTINCT ttl)), ',') AS ttl_values, max(md) AS ip_len_mode FROM pk JOIN md USING (proto) GROUP BY proto""")
def capture_info(spark, d):
    """A58."""
    c = FL.capture_info(X.packets(spark, d), ["proto"])
    return c.withColumn("ttl_values", F.array_join(F.transform("ttl_values", lambda x: x.cast("string")), ","))


@query("address_pair_packets", f"""WITH {PK} SELECT CASE WHEN outw THEN '10.0.0.' || user_id ELSE '10.1.0.1' END AS eth_src, CASE WHEN outw THEN '10.1.0.1' ELSE '10.0.0.' || user_id END AS eth_dst, proto, count(*) AS packets FROM pk GROUP BY ALL""")
def address_pair_packets(spark, d):
    """A58."""
    p = X.packets(spark, d).withColumn("eth_src", F.col("src")).withColumn("eth_dst", F.col("dst"))
    return FL.mac_pairs(p, ["proto"])


@query("shared_packet_keys", f"""WITH {EV}, a AS (SELECT DISTINCT user_id % 50 AS k, cents % 1000 AS l FROM ev WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id % 50 AS k, cents % 1000 AS l FROM ev WHERE event_id % 2 = 1)
SELECT (SELECT count(*) FROM a) AS keys_a, (SELECT count(*) FROM b) AS keys_b, (SELECT count(*) FROM a JOIN b USING (k, l)) AS shared,
  round((SELECT count(*) FROM a JOIN b USING (k, l)) / (SELECT count(*) FROM a)::DOUBLE, 6) AS share_of_a, round((SELECT count(*) FROM a JOIN b USING (k, l)) / (SELECT count(*) FROM b)::DOUBLE, 6) AS share_of_b""")
def shared_packet_keys(spark, d):
    """J9, U3."""
    e = X.events(spark, d).withColumn("k", F.pmod("user_id", F.lit(50))).withColumn("l", F.pmod("cents", F.lit(1000)))
    s = J.shared_keys(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["k", "l"])        # every event is on a side
    return r6(s)


NEAR = f"""{EV}, a AS (SELECT event_id, user_id, us / 1e6 AS ts FROM ev WHERE event_id % 2 = 0), b AS (SELECT user_id, us / 1e6 AS ts FROM ev WHERE event_id % 2 = 1),
j AS (SELECT a.event_id, a.user_id, p.ts - a.ts AS back, n.ts - a.ts AS ahead FROM a ASOF LEFT JOIN b p ON a.user_id = p.user_id AND a.ts >= p.ts ASOF LEFT JOIN b n ON a.user_id = n.user_id AND a.ts <= n.ts),
near AS (SELECT event_id, user_id, CASE WHEN ahead IS NULL OR abs(back) <= abs(ahead) THEN back ELSE ahead END AS dt FROM j)"""


def _near(spark, d):
    e = X.events(spark, d).withColumn("ts", F.col("us") / 1e6)
    a = e.filter("event_id % 2 = 0").select("event_id", "user_id", "ts")
    return J.nearest_in_time(a, e.filter("event_id % 2 = 1").select("user_id", "ts"), ["user_id"], "ts", 3600.0, cell_s=86400.0)


@query("nearest_in_time", f"WITH {NEAR} SELECT event_id, user_id, round(dt, 6) AS dt, coalesce(abs(dt) <= 3600e0, false)::INT AS matched FROM near")
def nearest_in_time(spark, d):
    """J5."""
    return _near(spark, d).select("event_id", "user_id", F.round("dt", 6).alias("dt"), F.col("matched").cast("int").alias("matched"))


@query("match_summary", f"""WITH {NEAR}, m AS (SELECT user_id % 5 AS src, dt, coalesce(abs(dt) <= 3600e0, false) AS matched FROM near)
SELECT src, count(*) AS n, count(*) FILTER (WHERE matched) AS n_matched, round(count(*) FILTER (WHERE matched) / count(*)::DOUBLE, 6) AS share, round(quantile_cont(dt, 0.5) FILTER (WHERE matched), 6) AS offset_median,
  round(quantile_cont(dt, 0.75) FILTER (WHERE matched) - quantile_cont(dt, 0.25) FILTER (WHERE matched), 6) AS offset_iqr, round(quantile_cont(dt, 0.01) FILTER (WHERE matched), 6) AS offset_p01, round(quantile_cont(dt, 0.99) FILTER (WHERE matched), 6) AS offset_p99 FROM m GROUP BY src""")
def match_summary(spark, d):
    """A61."""
    return r6(J.match_summary(_near(spark, d).withColumn("src", F.pmod("user_id", F.lit(5))), ["src"]))


# ------------------------------------------------------------- time splits
TL = f"""{SESS}, cc AS (SELECT session, user_id % 4 AS cat, count(*) AS c FROM s GROUP BY ALL),
tl AS (SELECT session, CASE WHEN cat = 0 THEN 'benign' ELSE 'attack_' || cat END AS category FROM (SELECT session, arg_min(cat, (-c, cat)) AS cat FROM cc GROUP BY session)), ns AS (SELECT count(*) AS n FROM tl)"""


def _timeline(spark, d):
    s = _sessions(spark, d).withColumn("cat", F.pmod("user_id", F.lit(4)))
    c = s.groupBy("session").agg(F.mode("cat", True).alias("cat"))
    return c.select("session", F.when(F.col("cat") == 0, "benign").otherwise(F.concat(F.lit("attack_"), F.col("cat").cast("string"))).alias("category"))


TEMP = f"""{TL}, sp AS (SELECT tl.*, train_frac, direction, CASE WHEN (row_number() OVER (PARTITION BY train_frac, direction ORDER BY session) <= round_even(train_frac * n, 0)) = (direction = 'forward') THEN 'train' ELSE 'test' END AS side
  FROM tl, ns, (SELECT unnest([0.4e0, 0.5e0, 0.6e0, 0.7e0]) AS train_frac), (SELECT unnest(['forward', 'reverse']) AS direction))"""
AUDIT = """ca AS (SELECT {k}, list_sort(list(DISTINCT category) FILTER (WHERE side = 'test')) AS ct, list(DISTINCT category) FILTER (WHERE side = 'train') AS cr, count(DISTINCT session) FILTER (WHERE side = 'test') AS n_test_sessions,
  count(DISTINCT session) FILTER (WHERE side = 'train') AS n_train_sessions, count(*) FILTER (WHERE side = 'test' AND category = 'benign') AS n_benign_test_sessions, count(*) FILTER (WHERE side = 'train' AND category = 'benign') AS n_benign_train_sessions FROM sp GROUP BY {k})
SELECT {k}, array_to_string(ct, ',') AS test_categories, array_to_string(list_filter(ct, lambda c: NOT list_contains(cr, c)), ',') AS unseen_test_categories, len(list_filter(ct, lambda c: NOT list_contains(cr, c) AND c <> 'benign'))::INT AS n_unseen_attack_categories,
  n_test_sessions, n_train_sessions, n_benign_test_sessions, n_benign_train_sessions FROM ca"""


@query("temporal_split", f"WITH {TEMP} SELECT session, train_frac, direction, side FROM sp")
def temporal_split(spark, d):
    """D11."""
    return D.temporal_split(_timeline(spark, d), [0.4, 0.5, 0.6, 0.7]).select("session", "train_frac", "direction", "side")


@query("coverage_audit", f"WITH {TEMP}, {AUDIT.format(k='train_frac, direction')}")
def coverage_audit(spark, d):
    """D14, U2."""
    return D.coverage_audit(D.temporal_split(_timeline(spark, d), [0.4, 0.5, 0.6, 0.7]), ["train_frac", "direction"])


@query("random_session_control", f"""WITH {TL}, sp AS (SELECT session, train_frac, rep, CASE WHEN row_number() OVER (PARTITION BY train_frac, rep ORDER BY {u("'rc|' || rep || '|' || session")}, session) <= round_even(train_frac * n, 0) THEN 'train' ELSE 'test' END AS side
  FROM tl, ns, (SELECT unnest([0.4e0, 0.7e0]) AS train_frac), (SELECT unnest(range(5)) AS rep)) SELECT session, train_frac, rep::INT AS rep, side FROM sp""")
def random_session_control(spark, d):
    """D12."""
    return D.random_session_control(_timeline(spark, d), [0.4, 0.7], 5).select("session", "train_frac", "rep", "side")


@query("time_stratified_split", f"""WITH {TL} SELECT session, category, direction, CASE WHEN session = CASE WHEN direction = 'forward' THEN max(session) OVER (PARTITION BY category) ELSE min(session) OVER (PARTITION BY category) END THEN 'test' ELSE 'train' END AS side
FROM tl, (SELECT unnest(['forward', 'reverse']) AS direction)""")
def time_stratified_split(spark, d):
    """D13."""
    return D.time_stratified_split(_timeline(spark, d)).select("session", "category", "direction", "side")


@query("nn_chance", f"""WITH {SESS}, n AS (SELECT session, count(*) AS ns FROM s GROUP BY session), {TL[len(SESS) + 2:]}, nc AS (SELECT category, sum(ns) AS nc FROM n JOIN tl USING (session) GROUP BY category)
SELECT count(*) AS sessions, sum(ns)::BIGINT AS windows, round(sum((ns / (SELECT count(*) FROM s)::DOUBLE) * (ns / (SELECT count(*) FROM s)::DOUBLE)), 6) AS chance_any,
  round(sum(ns / (SELECT count(*) FROM s)::DOUBLE * ns / nc), 6) AS chance_same_category FROM n JOIN tl USING (session) JOIN nc USING (category)""".replace(", ns AS (SELECT count(*) AS n FROM tl)", ""))
def nn_chance(spark, d):
    """A44."""
    s = _sessions(spark, d).select("session").join(_timeline(spark, d), "session")
    return r6(A.nn_chance(s, "session", "category"))
