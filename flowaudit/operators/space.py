"""The shared feature space and the column operators around it. Nothing here is fitted."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S

# Canonical columns and their order, floors and header lengths.
BASE_NUMERIC = ["duration", "src_bytes", "dst_bytes", "src_pkts", "dst_pkts", "tot_pkts", "tot_bytes"]
PROTO_LEVELS = ["tcp", "udp", "icmp", "other"]
PROTO_COLUMNS = ["proto_tcp", "proto_udp", "proto_icmp", "proto_other"]
DERIVED = ["mean_pkt_size", "src_mean_pkt_size", "dst_mean_pkt_size", "bytes_per_s", "pkts_per_s",
           "src_byte_ratio", "src_pkt_ratio"]
SHARED_COLUMNS = BASE_NUMERIC + PROTO_COLUMNS + DERIVED
LOG1P_COLUMNS = BASE_NUMERIC + ["mean_pkt_size", "src_mean_pkt_size", "dst_mean_pkt_size",
                                "bytes_per_s", "pkts_per_s"]
ROBUST_COLUMNS = PROTO_COLUMNS + ["mean_pkt_size", "src_mean_pkt_size", "dst_mean_pkt_size",
                                  "src_byte_ratio", "src_pkt_ratio"]
DURATION_FLOOR_S = 0.001
ETHERNET_BYTES = 14
GTPU_OVERHEAD_BYTES = 44
PROTO_NUMBERS = {1: "icmp", 6: "tcp", 17: "udp"}
IDENTITY_COLUMNS = ["uid", "src_ip", "dst_ip"]
LABEL_COLUMNS = ["attack_category", "attack_type", "traffic_type"]
PORT_COLUMNS = ["src_port", "dst_port"]
ZEEK_LOG_NAMES = {"id.orig_h": "src_ip", "id.resp_h": "dst_ip", "orig_ip_bytes": "src_ip_bytes",
                  "resp_ip_bytes": "dst_ip_bytes", "orig_pkts": "src_pkts", "resp_pkts": "dst_pkts"}


def require(df: DataFrame, cols: list[str], what: str) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise KeyError(f"{what}: missing columns {missing}")


def drop_identity(df: DataFrame, feature_set: str = "full") -> DataFrame:
    """P1."""
    drop = [*IDENTITY_COLUMNS, *LABEL_COLUMNS, "history"]
    if feature_set == "transferable":
        drop += PORT_COLUMNS
    elif feature_set != "full":
        raise ValueError(f"unknown feature_set {feature_set!r}")
    return df.drop(*drop)


def map_labels(df: DataFrame, col: str, mapping: dict, out: str, where: str = "labels",
               check: bool = True) -> DataFrame:
    """P2. Map through a small fixed vocabulary; a value outside it is an error, listed.

    With check=False the error is raised by the row that has the value, when it is read.
    """
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    hit = F.element_at(F.create_map(*pairs), F.col(col))
    if check:
        bad = df.filter(hit.isNull()).select(col).distinct().limit(20).collect()
        if bad:
            raise ValueError(f"{where}: unmapped label(s) {sorted(str(r[0]) for r in bad)}")
    msg = F.concat(F.lit(f"{where}: unmapped label "), F.coalesce(F.col(col).cast("string"), F.lit("NULL")))
    return df.withColumn(out, F.coalesce(hit, F.raise_error(msg).cast(T.StringType() if isinstance(
        next(iter(mapping.values())), str) else T.IntegerType())))


def unmapped_labels(df: DataFrame, col: str, mapping_df: DataFrame, key: str) -> DataFrame:
    """P2. The offenders as a table: values of `col` with no row in the mapping."""
    m = mapping_df.select(F.col(key).alias(col))
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).join(m, col, "left_anti")


def one_hot_fixed(df: DataFrame, col: str, levels: list[str], prefix: str) -> DataFrame:
    """P3. Fixed levels; an absent level gives a 0 column, NULL gives all zeros."""
    return df.select("*", *[F.coalesce((F.col(col) == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}")
                            for v in levels])


def one_hot_learned(df: DataFrame, cols: list[str]) -> DataFrame:
    """P4. Levels learned from the data: one column each, so the levels are as many as the result's columns."""
    for c in cols:
        rows = df.select(c).filter(F.col(c).isNotNull()).distinct().collect()
        df = one_hot_fixed(df, c, sorted(str(r[0]) for r in rows), c).drop(c)
    return df


def to_numeric(c: str | Column) -> Column:
    """P5. Non-numeric and missing become 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(S.nan_to_null(c.try_cast("double")), F.lit(0.0))


def numeric_fills(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5. How many values of each column were filled."""
    return df.agg(*[F.count_if(S.nan_to_null(F.col(c).try_cast("double")).isNull()).alias(c) for c in cols])


def normalise_proto(c: str | Column) -> Column:
    """P6."""
    v = F.lower(F.trim(S.as_col(c).cast("string")))
    return F.when(v.isin(PROTO_LEVELS[:3]), v).otherwise("other")


def proto_name(c: str | Column) -> Column:
    """P7."""
    m = F.create_map(*[x for k, v in PROTO_NUMBERS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, S.as_col(c).cast("int")), F.lit("other"))


def derived_features() -> dict[str, Column]:
    """P8. Ratios with floors: packets and bytes at least 1, duration at least 1 ms."""
    at1 = lambda c: F.greatest(F.col(c), F.lit(1.0))                     # noqa: E731
    dur = F.greatest(F.col("duration"), F.lit(DURATION_FLOOR_S))
    c = F.col
    return {"mean_pkt_size": c("tot_bytes") / at1("tot_pkts"),
            "src_mean_pkt_size": c("src_bytes") / at1("src_pkts"),
            "dst_mean_pkt_size": c("dst_bytes") / at1("dst_pkts"),
            "bytes_per_s": c("tot_bytes") / dur, "pkts_per_s": c("tot_pkts") / dur,
            "src_byte_ratio": c("src_bytes") / at1("tot_bytes"),
            "src_pkt_ratio": c("src_pkts") / at1("tot_pkts")}


def _finish(base: DataFrame, keep: list[str]) -> DataFrame:
    """P3, P8-P10 in one projection: derive, one-hot, log1p, finite, order."""
    d = base.select(*keep, *BASE_NUMERIC, "proto", *[v.alias(k) for k, v in derived_features().items()])
    out = []
    for name in SHARED_COLUMNS:
        if name in PROTO_COLUMNS:
            out.append((F.col("proto") == name[len("proto_"):]).cast("int").alias(name))
        else:
            x = S.log1p_floor(name) if name in LOG1P_COLUMNS else F.col(name)
            out.append(S.finite_or_zero(x).alias(name))
    return d.select(*keep, *out)


def shared_from_zeek(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """P11. IP bytes, never payload bytes; totals are source plus destination."""
    require(df, ["duration", "src_ip_bytes", "dst_ip_bytes", "src_pkts", "dst_pkts", "proto"], "zeek")
    n = to_numeric
    b = df.select(*keep, n("duration").alias("duration"), n("src_ip_bytes").alias("src_bytes"),
                  n("dst_ip_bytes").alias("dst_bytes"), n("src_pkts").alias("src_pkts"),
                  n("dst_pkts").alias("dst_pkts"), normalise_proto("proto").alias("proto"))
    b = b.withColumn("tot_pkts", F.col("src_pkts") + F.col("dst_pkts")) \
        .withColumn("tot_bytes", F.col("src_bytes") + F.col("dst_bytes"))
    return _finish(b, list(keep))


def shared_from_argus(df: DataFrame, keep: list[str] = (), link_bytes: int = ETHERNET_BYTES) -> DataFrame:
    """P12. Link header removed per packet and direction; link_bytes=0 keeps TotBytes."""
    require(df, ["Dur", "SrcBytes", "DstBytes", "SrcPkts", "DstPkts", "TotPkts", "TotBytes", "Proto"], "argus")
    n = to_numeric

    def ip(by: str, pk: str) -> Column:
        return F.greatest(n(by) - float(link_bytes) * n(pk), F.lit(0.0))
    b = df.select(*keep, n("Dur").alias("duration"), ip("SrcBytes", "SrcPkts").alias("src_bytes"),
                  ip("DstBytes", "DstPkts").alias("dst_bytes"), n("SrcPkts").alias("src_pkts"),
                  n("DstPkts").alias("dst_pkts"), n("TotPkts").alias("tot_pkts"),
                  n("TotBytes").alias("tot_bytes"), normalise_proto("Proto").alias("proto"))
    if link_bytes:
        b = b.withColumn("tot_bytes", F.col("src_bytes") + F.col("dst_bytes"))
    return _finish(b, list(keep))


def shared_from_nfstream(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """P13. Ethernet header, and inside a tunnel the encapsulation, removed per packet; ms to s."""
    require(df, ["bidirectional_duration_ms", "src2dst_bytes", "dst2src_bytes", "src2dst_packets",
                 "dst2src_packets", "protocol", "tunnel_id"], "nfstream")
    n = to_numeric
    over = F.when(n("tunnel_id") != 0, float(ETHERNET_BYTES + GTPU_OVERHEAD_BYTES)).otherwise(float(ETHERNET_BYTES))
    b = df.select(*keep, (n("bidirectional_duration_ms") / 1000.0).alias("duration"),
                  n("src2dst_packets").alias("src_pkts"), n("dst2src_packets").alias("dst_pkts"),
                  F.greatest(n("src2dst_bytes") - n("src2dst_packets") * over, F.lit(0.0)).alias("src_bytes"),
                  F.greatest(n("dst2src_bytes") - n("dst2src_packets") * over, F.lit(0.0)).alias("dst_bytes"),
                  proto_name(n("protocol")).alias("proto"))
    b = b.withColumn("tot_pkts", F.col("src_pkts") + F.col("dst_pkts")) \
        .withColumn("tot_bytes", F.col("src_bytes") + F.col("dst_bytes"))
    return _finish(b, list(keep))


def shared_from_zeek_log(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """P14. A conn.log after renaming its originator/responder columns."""
    return shared_from_zeek(df.withColumnsRenamed(ZEEK_LOG_NAMES), keep)


def assert_compatible(a: DataFrame, b: DataFrame, keep: list[str] = ()) -> None:
    """P15. Same names, order and number of feature columns."""
    ca, cb = ([c for c in d.columns if c not in keep] for d in (a, b))
    if ca != cb:
        raise ValueError(f"shared space mismatch: {ca} against {cb}")
    if len(ca) != len(SHARED_COLUMNS):
        raise ValueError(f"expected {len(SHARED_COLUMNS)} columns, got {len(ca)}")


def select_features(df: DataFrame, features: str, keep: list[str] = ()) -> DataFrame:
    """P16. The exporter-robust subset, or the whole space."""
    return df.select(*keep, *ROBUST_COLUMNS) if features == "robust" else df


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """P17. Whole-row duplicates. Rows that repeat only an id are kept."""
    return df.dropDuplicates()


def duplicate_stats(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """P17. Rows, exact duplicates and their rate, ids repeated among the kept rows."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    extra = [F.lit(0).cast("long").alias("repeated_ids")] if id_col is None else \
        [(F.count(F.lit(1)) - F.count_distinct(id_col)).alias("repeated_ids")]
    r = g.agg(F.sum("_c").alias("n_rows"), (F.sum("_c") - F.count(F.lit(1))).alias("n_duplicates"), *extra)
    return r.withColumn("duplicate_pct", 100.0 * F.col("n_duplicates") / F.col("n_rows"))


def drop_duplicates_subset(df: DataFrame, cols: list[str], row_id: str) -> DataFrame:
    """P18. First row (by row_id) of each distinct `cols`.

    The smallest id per content is a partial aggregate, so a content that repeats in a third
    of all rows is one row after the map side.
    """
    first = df.groupBy(*cols).agg(F.min(row_id).alias(row_id)).select(row_id)
    return df.join(first, row_id, "left_semi")


def informative_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """P19. Columns with a value and more than one distinct value, from min and max."""
    r = df.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols]).first()
    return [c for c in cols if r[f"lo_{c}"] is not None and r[f"lo_{c}"] != r[f"hi_{c}"]]


def drop_constant_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    keep = set(informative_columns(df, cols))
    return df.select(*[c for c in df.columns if c not in cols or c in keep])


def numeric_columns(df: DataFrame, drop: list[str] = (), suffixes: tuple = ()) -> list[str]:
    """P20."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
            and f.name not in drop and not (suffixes and f.name.endswith(tuple(suffixes)))]


def unordered_pair(a: str, b: str) -> Column:
    """P26."""
    return F.array_sort(F.array(F.col(a), F.col(b)))


def drop_background(df: DataFrame, col: str = "label", flag: bool = True) -> DataFrame:
    """P28."""
    return df.filter(F.col(col) != "background") if flag else df


def round_floats(df: DataFrame, places: int = 9) -> DataFrame:
    """P30. Doubles rounded half-even."""
    return df.select(*[F.bround(c, places).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def positional_names(df: DataFrame, cols: list[str], prefix: str = "f", with_name: bool = True) -> DataFrame:
    """P31. f00_name or f_00."""
    def clean(c: str) -> str:
        return c.strip().replace(" ", "_") or "blank"
    names = {c: f"{prefix}{i:02d}_{clean(c)}" if with_name else f"{prefix}_{i:02d}" for i, c in enumerate(cols)}
    return df.withColumnsRenamed(names)


def corpus_summary(df: DataFrame, y: str = "y", grp: str = "grp") -> DataFrame:
    """Rows, prevalence and number of groups of a corpus."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(y) * 100, 2).alias("attack_prevalence_pct"),
                  F.count_distinct(grp).alias("n_groups"))


def stable_sort(df: DataFrame, *cols: str) -> DataFrame:
    """T2. Multi-key order, made total by the last column."""
    return df.orderBy(*cols)


def top_n_per_group(counts: DataFrame, by: list[str], value: str, n_col: str, n: int) -> DataFrame:
    """T3. The n largest counts per group, ties by value. Input is one row per value."""
    w = Window.partitionBy(*by).orderBy(F.col(n_col).desc(), value)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
