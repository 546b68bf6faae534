"""Sessions, record windows and time grids of telemetry tables.

Times are BIGINT microseconds where a gap is tested, so the strict `>` is exact.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S

# The telemetry record, its counters and the default grid.
RADIO_FIELDS = ["dlBytes", "dlMcs", "dlBler", "ulBytes", "ulMcs", "ulBler", "ri", "phr", "pcmax",
                "rsrq", "sinr", "rsrp", "rssi", "cqi", "pucchSnr", "puschSnr"]
RADIO_COUNTERS = ["dlBytes", "ulBytes"]
SESSION_GAP_S = 300.0
WINDOW_RECORDS = 16
DAY_US = 86_400_000_000


def micros(ts: str | Column) -> Column:
    return F.unix_micros(S.as_col(ts))


def epoch_ms_to_timestamp(c: str | Column) -> Column:
    return F.timestamp_millis(S.as_col(c).cast("long"))


# ---------------------------------------------------------------- sessions
def session_cells(df: DataFrame, us: str, gaps_us: list[int], keys: list[str] = ()) -> DataFrame:
    """One row per (gap, cell) with its session.

    A cell is as wide as the gap, so no break can fall inside one: breaks lie between
    consecutive non-empty cells only. The ordered pass therefore reads one row per cell
    (time span / gap), whatever the number of records.
    """
    gaps = F.array(*[F.lit(int(g)).cast("long") for g in gaps_us])
    c = df.select(*keys, F.col(us).alias("_us"), F.explode(gaps).alias("gap_us"))
    cell = F.expr("(_us - pmod(_us, gap_us)) div gap_us")
    c = c.groupBy(*keys, "gap_us", cell.alias("cell")).agg(
        F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    w = Window.partitionBy(*keys, "gap_us").orderBy("cell")
    new = (F.col("_lo") - F.lag("_hi").over(w) > F.col("gap_us")).cast("int")
    c = c.withColumn("_new", F.coalesce(new, F.lit(0)))
    return c.withColumn("session", F.sum("_new").over(
        w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new", "_lo", "_hi")


def sessionize(df: DataFrame, us: str, gap_us: int, keys: list[str] = ()) -> DataFrame:
    """W1. `session` 0.. in time order; a gap strictly above gap_us starts a new one."""
    cells = session_cells(df, us, [gap_us], keys).drop("gap_us")
    d = df.withColumn("cell", F.expr(f"({us} - pmod({us}, {int(gap_us)}L)) div {int(gap_us)}L"))
    return d.join(cells, [*keys, "cell"]).drop("cell")


def session_summary(df: DataFrame, us: str, label: str, y: str | None = None,
                    device: str | None = None) -> DataFrame:
    """A5, W3. Per session: n, start, end, distinct labels, modal label (lowest tie), purity."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min(us).alias("start_us"), F.max(us).alias("end_us"),
            F.count_distinct(label).alias("n_categories"), F.mode(label, True).alias("category")]
    if y:
        aggs.append(F.avg(y).alias("attack_share"))
    if device:
        aggs.append(F.count_distinct(device).alias("n_ues"))
    return df.groupBy("session").agg(*aggs).withColumn(
        "label_pure", (F.col("n_categories") == 1).cast("int"))


def session_timeline(df: DataFrame, us: str, label: str, y: str, device: str) -> DataFrame:
    """W15. One row per session with minutes and the day offset from the first start."""
    s = session_summary(df, us, label, y, device)
    first = s.agg(F.min("start_us")).scalar()
    s = s.withColumn("duration_min", (F.col("end_us") - F.col("start_us")) / 60e6)
    return s.withColumn("day", (F.col("start_us") - first) / 86400e6)


def nested_segmentation(pairs: DataFrame, fine: str, coarse: str, keys: list[str]) -> DataFrame:
    """W19. Whether every fine segment lies inside one coarse segment."""
    p = pairs.groupBy(*keys, fine).agg(F.count_distinct(coarse).alias("_c"))
    return p.groupBy(*keys).agg((F.max("_c") == 1).cast("int").alias("nested_in_reference"))


def session_rule_sweep(df: DataFrame, us: str, gaps_us: list[int], ref_gap_us: int, category: str,
                       subcategory: str) -> DataFrame:
    """W2. Per gap: segments, category- and subcategory-pure segments, nesting in the reference.

    Records are first reduced to one row per (cell of the greatest common width, labels), so
    the expansion over gaps multiplies that small table and not the records.
    """
    gaps = sorted(set(gaps_us))
    cells = session_cells(df, us, sorted({*gaps, ref_gap_us}))
    lab = df.select(F.col(us).alias("_us"), F.col(category).alias("c1"), F.col(subcategory).alias("c2"))
    lab = lab.withColumn("gap_us", F.explode(F.array(*[F.lit(int(g)).cast("long") for g in gaps])))
    lab = lab.withColumn("cell", F.expr("(_us - pmod(_us, gap_us)) div gap_us")) \
        .withColumn("ref_cell", F.expr(f"(_us - pmod(_us, {ref_gap_us}L)) div {ref_gap_us}L"))
    lab = lab.groupBy("gap_us", "cell", "ref_cell", "c1", "c2").agg(F.count(F.lit(1)).alias("_n"))
    ref = cells.filter(F.col("gap_us") == ref_gap_us).select(F.col("cell").alias("ref_cell"),
                                                            F.col("session").alias("ref"))
    d = lab.join(cells, ["gap_us", "cell"]).join(ref, "ref_cell")
    seg = d.groupBy("gap_us", "session").agg(F.count_distinct("c1").alias("n1"),
                                             F.count_distinct("c2").alias("n2"),
                                             F.count_distinct("ref").alias("nr"))
    out = seg.groupBy("gap_us").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("n1") == 1).alias("n_category_pure"),
        F.count_if(F.col("n2") == 1).alias("n_subcategory_pure"),
        F.when(F.col("gap_us") <= ref_gap_us, (F.max("nr") == 1).cast("int")).alias("nested_in_reference"))
    return out


def gap_statistics(df: DataFrame, us: str) -> DataFrame:
    """A4. Median, p95, p99 and largest gap between consecutive records, rate, span in days.

    Times are cut at quantiles so that the lag runs in parallel; the first record of a
    bucket takes its predecessor from the last record of the bucket before.
    """
    t = O.quantile_buckets(O.cached(df.groupBy(F.col(us).alias("t")).agg(F.count(F.lit(1)).alias("c"))), "t")
    d = O.previous(t, ["t"], ["t"])
    gap = F.col("t") - F.col("_prev_t")
    d = d.withColumn("gap_s", gap / 1e6)
    # repeated times give gaps of 0; frequencies keep them without a row each
    z = d.select(F.explode(F.array(F.struct(F.col("gap_s").alias("g"), F.lit(1).cast("long").alias("f")),
                                   F.struct(F.lit(0.0).alias("g"), (F.col("c") - 1).alias("f")))).alias("x"),
                 "t").select("t", "x.g", "x.f").filter(F.col("g").isNotNull() & (F.col("f") > 0))
    q = O.exact_percentiles(z, "g", {"median_gap_s": 0.5, "p95_gap_s": 0.95, "p99_gap_s": 0.99}, freq=F.col("f"))
    top = z.agg(F.max("g").alias("max_gap_s"), F.sum("g").alias("_span"))
    r = q.withColumn("max_gap_s", top.select("max_gap_s").scalar()).withColumn("_span", top.select("_span").scalar())
    return (r.withColumn("implied_hz", F.try_divide(F.lit(1.0), F.col("median_gap_s")))
            .withColumn("span_days", F.col("_span") / 86400.0).drop("_span"))


# ----------------------------------------------------------------- counters
def counter_rates(df: DataFrame, device: str, us: str, counters: list[str], tie: list[str] = (),
                  bucket_us: int = DAY_US) -> DataFrame:
    """W4, W5. Per-device difference over elapsed seconds, across sessions.

    A falling counter gives 0 and sets `<c>_clamped`; equal times or a missing previous or
    current value give NULL. The previous record is the previous row of the device. A device
    is cut into time buckets, so one busy device is many tasks.
    """
    d = df.withColumn(O.BUCKET, F.floor(F.col(us) / bucket_us))
    d = O.previous(d, [us, *tie], [us, *counters], [device])
    dt = (F.col(us) - F.col(f"_prev_{us}")) / 1e6
    for c in counters:
        delta = F.col(c) - F.col(f"_prev_{c}")
        rate = F.when(dt > 0, F.greatest(S.dbl(delta), F.lit(0.0)) / dt)
        d = d.withColumn(f"{c}_rate", F.when(delta.isNotNull(), rate)) \
            .withColumn(f"{c}_clamped", F.coalesce((delta < 0).cast("int"), F.lit(0)))
    return d.drop(O.BUCKET, f"_prev_{us}", *[f"_prev_{c}" for c in counters])


# ----------------------------------------------------------- record windows
def record_windows(df: DataFrame, group: list[str], us: str, tie: list[str] = (),
                   size: int = WINDOW_RECORDS, bucket_us: int = DAY_US) -> DataFrame:
    """W7. Add window `w` and keep complete windows only.

    Records are numbered within (group, time bucket) and shifted by the records before the
    bucket, so one large group is many tasks.
    """
    d = df.withColumn(O.BUCKET, F.floor(F.col(us) / bucket_us))
    d = O.running_sums(d, [us, *tie], {"_rn": F.lit(1)}, group, totals=True)
    full = F.floor(F.col("_rn_all") / size) * size
    d = d.filter(F.col("_rn") <= full)
    return d.withColumn("w", F.floor((F.col("_rn") - 1) / size).cast("long")) \
        .withColumn("pos", ((F.col("_rn") - 1) % size).cast("int")).drop("_rn", "_rn_all", O.BUCKET)


def window_accounting(df: DataFrame, group: list[str], size: int = WINDOW_RECORDS) -> DataFrame:
    """W7, accounting form: groups, complete windows and dropped records."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    full = F.floor(F.col("n") / size)
    r = n.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") >= size).alias("groups_with_enough"),
              F.sum(full).alias("complete_windows"), F.sum("n").alias("n_records"))
    drop = F.col("n_records") - F.col("complete_windows") * size
    return r.withColumn("records_dropped", drop).withColumn("drop_rate_pct",
                                                            100.0 * drop / F.col("n_records"))


def window_features(win: DataFrame, group: list[str], cols: list[str], label: str, y: str) -> DataFrame:
    """A6. Mean and sample sd per window, modal label (lowest tie), largest y."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return win.groupBy(*group, "w").agg(*aggs, F.mode(label, True).alias("category"),
                                        F.max(y).cast("int").alias("y"))


def window_sequences(win: DataFrame, group: list[str], cols: list[str], y: str) -> DataFrame:
    """W8. The same windows as ordered size x k arrays, missing values 0."""
    vec = F.array(*[F.coalesce(S.dbl(c), F.lit(0.0)) for c in cols])
    s = win.groupBy(*group, "w").agg(
        F.array_sort(F.collect_list(F.struct("pos", vec.alias("v")))).alias("_s"), F.max(y).alias("y"))
    return s.select(*group, "w", F.transform("_s", lambda e: e["v"]).alias("seq"), "y")


# --------------------------------------------------------------- time grids
def window_grid(spans: DataFrame, keys: list[str], t0: str, t1: str, width: float,
                stride: float) -> DataFrame:
    """W9. Windows [t0 + i*stride, + width) while the start is below t1, at least one."""
    n = F.greatest(F.ceil((F.col(t1) - F.col(t0)) / stride).cast("int"), F.lit(1))
    g = spans.filter(F.col(t1) >= F.col(t0)).withColumn("idx", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col(t0) + F.col("idx") * stride
    return g.select(*keys, "idx", start.alias("win_start"), (start + width).alias("win_end"))


def overlap_window(a: DataFrame, b: DataFrame, keys: list[str], a_start: str, a_end: str,
                   b_start: str) -> DataFrame:
    """W10. Intersection and union of the two capture spans per run."""
    sa = a.groupBy(*keys).agg(F.min(a_start).alias("a_lo"), F.max(a_end).alias("a_hi"),
                              F.count(F.lit(1)).alias("n_a"))
    sb = b.groupBy(*keys).agg(F.min(b_start).alias("b_lo"), F.max(b_start).alias("b_hi"),
                              F.count(F.lit(1)).alias("n_b"))
    s = sa.join(sb, keys)
    return (s.withColumn("lo", F.greatest("a_lo", "b_lo")).withColumn("hi", F.least("a_hi", "b_hi"))
            .withColumn("union_s", F.greatest("a_hi", "b_hi") - F.least("a_lo", "b_lo")))


def to_grid(df: DataFrame, spans: DataFrame, keys: list[str], t: str, width: float,
            stride: float) -> DataFrame:
    """Assign rows to every window of their run that covers them; windows past `hi` drop out."""
    d = df.join(spans.select(*keys, "lo", "hi"), keys)
    off = F.col(t) - F.col("lo")
    last = F.floor(off / stride).cast("int")
    if stride >= width:
        d = d.withColumn("idx", last)
    else:
        first = F.greatest(F.floor((off - width) / stride).cast("int") + 1, F.lit(0))
        d = d.filter(off >= 0).withColumn("idx", F.explode(F.sequence(first, last)))
    start = F.col("lo") + F.col("idx") * stride
    n = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / stride).cast("int"), F.lit(1))
    ok = (off >= 0) & (F.col(t) < start + width) & (start + width <= F.col("hi")) & (F.col("idx") < n)
    return d.filter(ok).drop("lo", "hi")


def layer_aggregate(df: DataFrame, keys: list[str], cols: list[str], prefix: str, count: str,
                    distinct: dict[str, str] = {}, log1p: list[str] = (), sums: bool = True) -> DataFrame:
    """A7, A8. Count, distinct counts, mean, population sd (and sum) of each column per window."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_{count}")]
    aggs += [F.count_distinct(c).alias(f"{prefix}_{n}") for n, c in distinct.items()]
    for c in cols:
        x = S.signed_log1p(c) if c in log1p else S.dbl(c)
        aggs += [F.avg(x).alias(f"{prefix}_{c}_mean"), F.stddev_pop(x).alias(f"{prefix}_{c}_sd")]
        if sums:
            aggs.append(F.sum(x).alias(f"{prefix}_{c}_sum"))
    return df.groupBy(*keys, "idx").agg(*aggs)


def window_join(net: DataFrame, radio: DataFrame, keys: list[str], require_net: bool = True,
                require_radio: bool = True) -> DataFrame:
    """J6. Both layers on one grid; a required side must be present."""
    j = net.withColumn("_n", F.lit(1)).join(radio.withColumn("_r", F.lit(1)), [*keys, "idx"], "full_outer")
    if require_net:
        j = j.filter(F.col("_n").isNotNull())
    if require_radio:
        j = j.filter(F.col("_r").isNotNull())
    return j.drop("_n", "_r")


def join_stats(net: DataFrame, radio: DataFrame, spans: DataFrame, keys: list[str], width: float,
               stride: float) -> DataFrame:
    """A59. Overlap, start offset, windows in the grid, joined, network only and radio only."""
    j = net.select(*keys, "idx", F.lit(1).alias("_n")).join(
        radio.select(*keys, "idx", F.lit(1).alias("_r")), [*keys, "idx"], "full_outer")
    c = j.groupBy(*keys).agg(
        F.count_if(F.col("_n").isNotNull() & F.col("_r").isNotNull()).alias("windows_joined"),
        F.count_if(F.col("_r").isNull()).alias("windows_network_only"),
        F.count_if(F.col("_n").isNull()).alias("windows_radio_only"))
    d = spans.join(c, keys, "left")
    ov = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.0))
    n = F.when(F.col("hi") >= F.col("lo"),
               F.greatest(F.ceil((F.col("hi") - F.col("lo")) / stride), F.lit(1))).otherwise(0)
    d = d.withColumn("overlap_s", ov).withColumn("overlap_fraction", S.ratio0(ov, "union_s")) \
        .withColumn("start_offset_s", F.col("a_lo") - F.col("b_lo")).withColumn("windows_in_grid", n)
    for k in ("windows_joined", "windows_network_only", "windows_radio_only"):
        d = d.withColumn(k, F.coalesce(F.col(k), F.lit(0)))
    return d.withColumn("join_rate", S.ratio0("windows_joined", "windows_in_grid"))


def join_summary(stats: DataFrame) -> DataFrame:
    """A59. Medians over runs."""
    ab = F.abs("start_offset_s")
    return stats.agg(F.count(F.lit(1)).alias("n_runs"), F.sum("windows_joined").alias("total_windows_joined"),
                     F.median("join_rate").alias("median_join_rate"), F.min("join_rate").alias("min_join_rate"),
                     F.median("overlap_fraction").alias("median_overlap_fraction"),
                     F.median(ab).alias("median_abs_start_offset_s"), F.max(ab).alias("max_abs_start_offset_s"))


# ------------------------------------------------------------- capture files
def capture_files(df: DataFrame, row_id: str, offset: str, bucket_rows: int = 1_000_000) -> DataFrame:
    """W6. 1-based file id: a new file starts wherever the offset falls in row order.

    Row ids are cut into fixed ranges. The first row of a range compares with the last row
    of the one before, and the falls are summed over ranges, so no task sees all rows.
    """
    d = df.withColumn(O.BUCKET, F.floor(F.col(row_id) / bucket_rows).cast("long"))
    d = O.previous(d, [row_id], [offset])
    fall = F.coalesce((F.col(offset) < F.col(f"_prev_{offset}")).cast("int"), F.lit(0))
    d = d.withColumn("_fall", fall).drop(f"_prev_{offset}")
    out = O.running_sums(d, [F.col(row_id)], {"file": F.col("_fall")})
    return out.withColumn("file", (F.col("file") + 1).cast("long")).drop("_fall", O.BUCKET)


def session_map(sessions: DataFrame, counts: DataFrame) -> DataFrame:
    """J21. Windows per session on the timeline, with a check that both derivations agree.

    `counts` has (session, category, n_windows) from the windows; `agree` is 0 where a
    session's windows carry another category than its timeline row.
    """
    c = counts.groupBy("session").agg(F.sum("n_windows").alias("n_windows"),
                                      F.count_distinct("category").alias("_nc"),
                                      F.min("category").alias("_c"))
    d = sessions.join(c, "session", "left")
    ok = (F.col("_nc") == 1) & (F.col("_c") == F.col("category"))
    return d.withColumn("n_windows", F.coalesce("n_windows", F.lit(0))) \
        .withColumn("agree", F.when(F.col("_nc").isNotNull(), ok.cast("int"))).drop("_nc", "_c")
