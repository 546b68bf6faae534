"""The driver's tables as the domain tables of the evaluation.

Each binding is a projection of whole tables. Its SQL twin in `oracle.py` states the same
rule for the reference engine.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import spread

SEEDS = [101, 102, 103, 104]
MODELS = {"linear": 0.35, "boost": 0.5, "net": 0.65}       # weight of the label in the score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_id() -> Column:
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long")
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents.cast("string"))


def _category() -> Column:
    return F.when(F.col("y") == 1, F.concat(F.lit("attack_"), F.col("l_linenumber").cast("string"))).otherwise("benign")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records: source group, volumes, label, category, capture file, flagged copies."""
    d = spread(table(spark, sf_dir, "lineitem"))
    y = (F.col("l_returnflag") == "R").cast("int")
    d = d.withColumn("row_id", _row_id())
    return (d.withColumn("y", y).withColumn("grp", F.col("l_suppkey").cast("string")).withColumn("category", _category())
            .withColumn("file", F.year("l_shipdate") - 1994)
            .withColumn("is_copy", (y == 0) & (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)))


def scores(spark: SparkSession, sf_dir: str, per_split: dict[str, Column] | None = None) -> DataFrame:
    """Scores of three detectors under four splits.

    `per_split` adds columns that no detector decides (of `split_seed`, `domain` and the kept
    columns): they are computed once for the three scores of a row.

    Rows with line status O are the source corpus; a fifth of its groups is held out per
    split. The others are the target, scored under every split. The detectors lose part of
    their signal on the target.
    """
    d = lineitem(spark, sf_dir).withColumn("_md", F.md5("row_id"))
    u = {m: F.conv(F.substring("_md", 1 + 8 * i, 8), 16, 10).cast("long") / 4294967296.0 for i, m in enumerate(MODELS)}
    src = F.col("l_linestatus") == "O"
    raw = F.array(*[F.struct(F.lit(m).alias("model"), u[m].alias("u"),
                             F.when(src, F.lit(k)).otherwise(F.lit(k * 0.5)).alias("k")) for m, k in MODELS.items()])
    held = {s: S.hash_unit(F.lit(f"held{s}"), "grp") < 0.2 for s in SEEDS}
    seeds = F.array(*[F.struct(F.lit(s).alias("s"), (~src | h).alias("in")) for s, h in held.items()])
    keep = ["row_id", "y", "category", "grp", "file", "is_copy"]
    d = d.select(*keep, "_md", "l_linestatus", F.when(src, "source_heldout").otherwise("target").alias("domain"), F.explode(seeds).alias("_s"))
    # the array is written inside explode: as a column of its own, a size filter over it would be pushed to the scan
    d = d.filter("_s.in").withColumn("split_seed", F.col("_s.s")).withColumns(per_split or {})
    keep += list(per_split or {})
    d = d.select(*keep, "domain", "split_seed", F.explode(raw).alias("_r"))
    jitter = F.pmod(F.col("split_seed") * 37, F.lit(11)) * 0.004
    s = F.col("_r.k") * F.col("y") + (1.0 - F.col("_r.k")) * F.col("_r.u") + jitter
    s = F.least(F.floor(s * 10000.0) / 10000.0, F.lit(1.0))
    return d.select(F.col("_r.model").alias("model"), "split_seed", "domain", *keep, s.alias("score"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry: time in µs, device, gauge, label, and a counter that wraps."""
    d = table(spark, sf_dir, "events")
    y = (F.col("event_type") == "error").cast("int")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return d.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "event_type", "value",
                    y.alias("y"), cents.alias("cents"), F.pmod(F.col("event_id") * 977 + cents, F.lit(100000)).alias("counter"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets: one 5-tuple per user, both directions, TCP for even users and UDP for odd ones."""
    e = events(spark, sf_dir)
    out = F.pmod("event_id", F.lit(3)) != 0
    host, port = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), (F.col("user_id") + 1024).cast("int")
    srv, sport = F.lit("10.1.0.1"), F.lit(443)
    size = (F.lit(40) + F.pmod(F.col("cents"), F.lit(1460))).cast("int")
    tcp = F.pmod("user_id", F.lit(2)) == 0
    flags = F.element_at(F.array(*[F.lit(v) for v in (2, 18, 16, 24, 17)]), (F.pmod("event_id", F.lit(5)) + 1).cast("int"))
    return e.select((F.col("us") / 1e6).alias("ts"), F.col("event_id").alias("seq"), "user_id",
                    F.when(out, host).otherwise(srv).alias("src"), F.when(out, srv).otherwise(host).alias("dst"),
                    F.when(out, port).otherwise(sport).alias("sport"), F.when(out, sport).otherwise(port).alias("dport"),
                    F.when(tcp, 6).otherwise(17).alias("proto"), (F.lit(64) - F.pmod("user_id", F.lit(4))).cast("int").alias("ttl"),
                    size.alias("ip_len"), (size - 40).alias("payload_len"), F.when(tcp, flags).otherwise(0).alias("flags"))


def zeek_flows(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """Source corpus in the first exporter's columns: line items with their order's date.

    Numbers go through the join, and texts (row id, group, category) are made of them behind it.
    With `stored` the numbers are kept, for runs that read the corpus many times.
    """
    li, o = spread(table(spark, sf_dir, "lineitem")), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    y = (F.col("l_returnflag") == "R").cast("int")
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", y.alias("y"),
                   ((y == 0) & (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)).alias("is_copy"))
    d = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("days", F.abs(F.datediff("l_shipdate", "o_orderdate"))) \
        .withColumn("file", F.year("l_shipdate") - 1994).drop("o_orderkey", "o_orderdate", "l_shipdate")
    if stored:
        d = d.drop("o_orderpriority").persist()
    proto = F.element_at(F.array(F.lit("TCP"), F.lit("udp "), F.lit("icmp"), F.lit("sctp")), (F.pmod("l_partkey", F.lit(4)) + 1).cast("int"))
    return d.select(_row_id().alias("row_id"), F.col("l_suppkey").cast("string").alias("grp"), "y", _category().alias("category"), "file", "is_copy",
                    F.col("days").cast("double").alias("duration"), F.col("l_extendedprice").alias("src_ip_bytes"),
                    (F.col("l_extendedprice") * F.col("l_discount")).alias("dst_ip_bytes"),
                    F.col("l_quantity").alias("src_pkts"), F.col("l_linenumber").cast("double").alias("dst_pkts"), proto.alias("proto"),
                    *([] if stored else ["o_orderpriority"]))


def argus_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second corpus in the second exporter's columns: orders with their customer."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    pk = (F.pmod("o_orderkey", F.lit(50)) + 1).cast("double")
    dp = F.pmod("o_custkey", F.lit(7)).cast("double")
    dst = F.abs("c_acctbal")
    proto = F.element_at(F.array(F.lit("tcp"), F.lit("udp"), F.lit("icmp"), F.lit("arp")), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    return d.select(F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_custkey").cast("string").alias("grp"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("c_mktsegment").alias("category"),
                    F.pmod("o_custkey", F.lit(90)).cast("double").alias("Dur"),
                    F.col("o_totalprice").alias("SrcBytes"), dst.alias("DstBytes"), pk.alias("SrcPkts"), dp.alias("DstPkts"),
                    (pk + dp).alias("TotPkts"), (F.col("o_totalprice") + dst).alias("TotBytes"), proto.alias("Proto"))


def published_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second corpus as a published pipeline sees it: numeric columns, one-hot protocol, two counters that give a
    record's position (Seq, Offset), capture file by year, station by file, and flagged copies."""
    a = argus_flows(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("row_id"), F.col("o_orderkey").alias("Seq"), (F.year("o_orderdate") - 1991).alias("file"))
    start = o.groupBy("file").agg(F.min("Seq").alias("_first"))
    o = o.join(start, "file").withColumn("Offset", (F.col("Seq") - F.col("_first")) * 64).drop("_first")
    proto = [(F.col("Proto") == p).cast("double").alias(p) for p in ("tcp", "udp", "icmp", "arp")]
    num = [F.col(c).cast("double").alias(c) for c in ("Seq", "Offset", "Dur", "SrcBytes", "DstBytes", "SrcPkts", "DstPkts", "TotPkts", "TotBytes")]
    return a.join(o, "row_id").select("row_id", "y", "category", "grp", "file", F.when(F.col("file") <= 4, 1).otherwise(2).alias("site"),
                                      ((F.col("y") == 0) & (F.pmod("Seq", F.lit(20)) == 0)).alias("is_copy"), *num, *proto)


def nfstream_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third corpus in the third exporter's columns: line items."""
    pr = F.element_at(F.array(F.lit(1), F.lit(6), F.lit(17), F.lit(132)), (F.pmod("l_partkey", F.lit(4)) + 1).cast("int"))
    return lineitem(spark, sf_dir).select(
        "row_id", "y", "category", "grp", "file", F.col("l_suppkey").alias("bidirectional_duration_ms"), F.col("l_extendedprice").alias("src2dst_bytes"),
        (F.col("l_extendedprice") / 10).alias("dst2src_bytes"), F.col("l_quantity").alias("src2dst_packets"),
        F.col("l_linenumber").alias("dst2src_packets"), pr.alias("protocol"), F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("tunnel_id"))
