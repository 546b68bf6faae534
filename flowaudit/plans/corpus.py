"""Queries over flow tables: feature space, profile, label conflicts, groupings, splits."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit as A
from ..operators import inference as I
from ..operators import joins as J
from ..operators import perturb as R
from ..operators import shift as SH
from ..operators import space as SP
from ..operators import splits as D
from . import bindings as X
from .registry import LI, h, query, r6, u

# ----------------------------------------------------------- shared space
ZEEK = LI + """, zk AS (SELECT li.*, abs(date_diff('day', o_orderdate, l_shipdate))::DOUBLE AS duration, l_extendedprice AS src_bytes, l_extendedprice * l_discount AS dst_bytes, l_quantity AS src_pkts, l_linenumber::DOUBLE AS dst_pkts,
  (['TCP', 'udp ', 'icmp', 'sctp'])[(l_partkey % 4) + 1] AS proto0 FROM li JOIN orders ON l_orderkey = o_orderkey),
base AS (SELECT *, src_pkts + dst_pkts AS tot_pkts, src_bytes + dst_bytes AS tot_bytes, CASE WHEN lower(trim(proto0)) IN ('tcp', 'udp', 'icmp') THEN lower(trim(proto0)) ELSE 'other' END AS proto FROM zk)"""
ARGUS = """ar AS (SELECT o_orderkey, o_orderkey::VARCHAR AS row_id, (o_custkey % 90)::DOUBLE AS duration, (o_orderkey % 50 + 1)::DOUBLE AS src_pkts, (o_custkey % 7)::DOUBLE AS dst_pkts, o_totalprice AS sb, abs(c_acctbal) AS db,
  (['tcp', 'udp', 'icmp', 'arp'])[(o_custkey % 4) + 1] AS proto0, (o_orderstatus = 'F')::INT AS y, c_mktsegment AS category FROM orders JOIN customer ON o_custkey = c_custkey),
base0 AS (SELECT *, greatest(sb - 14e0 * src_pkts, 0e0) AS src_bytes, greatest(db - 14e0 * dst_pkts, 0e0) AS dst_bytes, src_pkts + dst_pkts AS tot_pkts, CASE WHEN proto0 = 'arp' THEN 'other' ELSE proto0 END AS proto FROM ar),
base AS (SELECT *, src_bytes + dst_bytes AS tot_bytes FROM base0)"""
_L = "ln(1 + greatest({}, 0e0))"
_EXPR = {**{c: c for c in SP.BASE_NUMERIC},
         "mean_pkt_size": "tot_bytes / greatest(tot_pkts, 1e0)", "src_mean_pkt_size": "src_bytes / greatest(src_pkts, 1e0)",
         "dst_mean_pkt_size": "dst_bytes / greatest(dst_pkts, 1e0)", "bytes_per_s": "tot_bytes / greatest(duration, 0.001e0)",
         "pkts_per_s": "tot_pkts / greatest(duration, 0.001e0)", "src_byte_ratio": "src_bytes / greatest(tot_bytes, 1e0)",
         "src_pkt_ratio": "src_pkts / greatest(tot_pkts, 1e0)"}


def shared_sql(rounded: bool = True) -> str:
    out = []
    for c in SP.SHARED_COLUMNS:
        if c in SP.PROTO_COLUMNS:
            out.append(f"(proto = '{c[6:]}')::INT AS {c}")
        else:
            e = _L.format(_EXPR[c]) if c in SP.LOG1P_COLUMNS else _EXPR[c]
            out.append(f"round({e}, 6) AS {c}" if rounded else f"{e} AS {c}")
    return ", ".join(out)


@query("shared_space_zeek", f"WITH {ZEEK} SELECT row_id, {shared_sql()} FROM base")
def shared_space_zeek(spark, d):
    """P3, P5, P6, P8-P11."""
    return r6(SP.shared_from_zeek(X.zeek_flows(spark, d), ["row_id"]))


@query("shared_space_argus", f"WITH {ARGUS} SELECT row_id, {shared_sql()} FROM base")
def shared_space_argus(spark, d):
    """P12."""
    return r6(SP.shared_from_argus(X.argus_flows(spark, d), ["row_id"]))


@query("shared_space_two_sources", f"""WITH z AS (WITH {ZEEK} SELECT 'a' AS corpus, {shared_sql(False)} FROM base), a AS (WITH {ARGUS} SELECT 'b' AS corpus, {shared_sql(False)} FROM base), un AS (SELECT * FROM z UNION ALL SELECT * FROM a)
SELECT corpus, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in SP.ROBUST_COLUMNS)} FROM un GROUP BY corpus""")
def shared_space_two_sources(spark, d):
    """Both corpora in one space."""
    z, a = SP.shared_from_zeek(X.zeek_flows(spark, d)), SP.shared_from_argus(X.argus_flows(spark, d))
    SP.assert_compatible(z, a)
    un = z.withColumn("corpus", F.lit("a")).unionByName(a.withColumn("corpus", F.lit("b")))
    return r6(un.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in SP.ROBUST_COLUMNS]))


@query("shared_space_nfstream", """WITH n AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity AS sp, (l_linenumber)::DOUBLE AS dp, l_extendedprice AS sb, CASE WHEN l_tax > 0.04e0 THEN 58e0 ELSE 14e0 END AS o,
  ([1, 6, 17, 132])[(l_partkey % 4) + 1] AS pr FROM lineitem)
SELECT pr::INT AS protocol, count(*) AS n, round(avg(ln(1 + greatest(sb - sp * o, 0e0))), 6) AS src_bytes, round(avg(ln(1 + greatest(sb / 10 - dp * o, 0e0))), 6) AS dst_bytes,
  round(avg(ln(1 + l_suppkey / 1000e0)), 6) AS duration, sum((pr = 6)::INT)::BIGINT AS proto_tcp, sum((pr = 132)::INT)::BIGINT AS proto_other FROM n GROUP BY pr""")
def shared_space_nfstream(spark, d):
    """P7, P13."""
    li = X.table(spark, d, "lineitem")
    pr = F.element_at(F.array(F.lit(1), F.lit(6), F.lit(17), F.lit(132)), (F.pmod("l_partkey", F.lit(4)) + 1).cast("int"))
    nf = li.select(F.col("l_suppkey").alias("bidirectional_duration_ms"), F.col("l_extendedprice").alias("src2dst_bytes"), (F.col("l_extendedprice") / 10).alias("dst2src_bytes"),
                   F.col("l_quantity").alias("src2dst_packets"), F.col("l_linenumber").alias("dst2src_packets"), pr.alias("protocol"),
                   F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("tunnel_id"))
    s = SP.shared_from_nfstream(nf.withColumn("pr", F.col("protocol")), ["pr"])
    return r6(s.groupBy(F.col("pr").alias("protocol")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("src_bytes", "dst_bytes", "duration")],
                                                         F.sum("proto_tcp").alias("proto_tcp"), F.sum("proto_other").alias("proto_other")))


@query("one_hot", """SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS o_orderpriority_1, (o_orderpriority = '2-HIGH')::INT AS o_orderpriority_2, (o_orderpriority = '9-NONE')::INT AS o_orderpriority_9,
  (o_orderstatus = 'F')::INT AS o_orderstatus_F, (o_orderstatus = 'O')::INT AS o_orderstatus_O, (o_orderstatus = 'P')::INT AS o_orderstatus_P FROM orders""")
def one_hot(spark, d):
    """P3, P4."""
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    o = SP.one_hot_fixed(o, "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NONE"], "p").drop("o_orderpriority")
    o = SP.one_hot_learned(o, ["o_orderstatus"])
    return o.withColumnsRenamed({"p_1-URGENT": "o_orderpriority_1", "p_2-HIGH": "o_orderpriority_2", "p_9-NONE": "o_orderpriority_9"})


MAP = {"AUTOMOBILE": 1, "BUILDING": 1, "FURNITURE": 0, "HOUSEHOLD": 0}


@query("strict_map", """SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') GROUP BY c_mktsegment""")
def strict_map(spark, d):
    """The offenders of a label map."""
    m = spark.createDataFrame(list(MAP.items()), "label string, y int")
    return SP.unmapped_labels(X.table(spark, d, "customer"), "c_mktsegment", m, "label")


@query("numeric_fill", """SELECT count(*) FILTER (WHERE try_cast(o_orderpriority AS DOUBLE) IS NULL) AS priority_filled, round(sum(coalesce(try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE), 0)), 6) AS digit_sum FROM orders""")
def numeric_fill(spark, d):
    """P5."""
    o = X.table(spark, d, "orders").withColumn("digit", F.substring("o_orderpriority", 1, 1))
    f = SP.numeric_fills(o, ["o_orderpriority"]).select(F.col("o_orderpriority").alias("priority_filled"))
    return f.withColumn("digit_sum", F.round(o.agg(F.sum(SP.to_numeric("digit"))).scalar(), 6))


@query("transferable_columns", """SELECT column_name AS name, count(*) AS n_values FROM lineitem, (SELECT unnest(['dst_pkts', 'duration', 'proto', 'src_ip_bytes', 'src_pkts']) AS column_name) GROUP BY ALL""")
def transferable_columns(spark, d):
    """What is left of the source table without identities, labels and ports, and how many values each column has."""
    z = X.zeek_flows(spark, d).select(F.col("grp").alias("src_ip"), "duration", "src_ip_bytes", "src_pkts", "dst_pkts", "proto", F.col("y").alias("traffic_type"),
                                      F.col("category").alias("attack_category"), F.lit(1).alias("src_port"))
    left = SP.drop_identity(z, "transferable")
    per = left.agg(*[F.count(c).alias(c) for c in left.columns])
    return per.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n_values")) for c in sorted(left.columns)])).alias("r")).select("r.*")


@query("duplicates", """WITH g AS (SELECT text, lang, source, count(*) AS c FROM documents GROUP BY ALL)
SELECT sum(c)::BIGINT AS n_rows, (sum(c) - count(*))::BIGINT AS n_duplicates, (count(*) - count(DISTINCT text))::BIGINT AS repeated_ids, round(100e0 * (sum(c) - count(*)) / sum(c), 6) AS duplicate_pct FROM g""")
def duplicates(spark, d):
    """P17, U4."""
    return r6(SP.duplicate_stats(X.table(spark, d, "documents").select("text", "lang", "source"), "text"))


@query("duplicates_subset", """SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang""")
def duplicates_subset(spark, d):
    """P18, T6."""
    return SP.drop_duplicates_subset(X.table(spark, d, "documents").select("doc_id", "text", "lang"), ["text", "lang"], "doc_id").select("doc_id")


@query("constant_columns", """SELECT count(*) AS n, 4 AS n_columns FROM lineitem""")
def constant_columns(spark, d):
    """P19, P20, P31."""
    li = X.table(spark, d, "lineitem").withColumn("always", F.lit(1)).select("l_quantity", "l_discount", "l_tax", "always", "l_linenumber", F.lit(None).cast("double").alias("gone"))
    k = SP.drop_constant_columns(li, SP.numeric_columns(li))
    k = SP.positional_names(k, k.columns)
    return k.agg(F.count("f00_l_quantity").alias("n"), F.lit(len(k.columns)).alias("n_columns"))


@query("corpus_summary", f"WITH {LI} SELECT count(*) AS n_rows, round(avg(y) * 100, 2) AS attack_prevalence_pct, count(DISTINCT grp) AS n_groups FROM li")
def corpus_summary(spark, d):
    """The corpus in one row."""
    return SP.corpus_summary(X.lineitem(spark, d))


# ---------------------------------------------------------------- profile
_PC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_PT = ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string", "timestamp_ntz"]


@query("profile", f"""WITH g AS (SELECT {', '.join(_PC)}, count(*) AS c FROM lineitem GROUP BY ALL), t AS (SELECT sum(c) AS n, sum(c) - count(*) AS dup FROM g)
SELECT "column", dtype, n::BIGINT AS n_rows, 0e0 AS null_pct, dup::BIGINT AS exact_duplicate_rows, round(100e0 * dup / n, 6) AS exact_duplicate_pct FROM t, (SELECT unnest({_PC}) AS "column", unnest({_PT}) AS dtype)""")
def profile(spark, d):
    """A1."""
    return r6(A.profile(X.table(spark, d, "lineitem").select(*_PC)))


@query("group_key_feasibility", """WITH l AS (SELECT 'l_suppkey' AS k, l_suppkey::VARCHAR AS v FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem),
c AS (SELECT k, v, count(*) AS n FROM l GROUP BY k, v), g AS (SELECT k, count(v) AS ng, 100e0 * coalesce(sum(n) FILTER (WHERE v IS NULL), 0) / sum(n) AS np, max(n) / sum(n) AS ls FROM c GROUP BY k)
SELECT k AS "key", ng AS n_groups, round(np, 6) AS null_pct, round(ls, 6) AS largest_group_share, CASE WHEN ng < 5 THEN 'TOO FEW' WHEN ng < 10 THEN 'TIGHT' WHEN ls > 0.5e0 THEN 'IMBALANCED' ELSE 'OK' END AS verdict FROM g
UNION ALL SELECT 'ue_id', NULL, NULL, NULL, 'ABSENT'""")
def group_key_feasibility(spark, d):
    """A2."""
    return r6(A.group_key_feasibility(X.table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber", "l_returnflag", "ue_id"]))


@query("value_shares", """WITH a AS (SELECT c_nationkey AS k, 100e0 * count(*) / (SELECT count(*) FROM customer) AS p FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, 100e0 * count(*) / (SELECT count(*) FROM supplier) AS p FROM supplier GROUP BY 1)
SELECT k, round(coalesce(a.p, 0), 6) AS a_pct, round(coalesce(b.p, 0), 6) AS b_pct, round(abs(coalesce(a.p, 0) - coalesce(b.p, 0)), 6) AS abs_diff FROM a FULL JOIN b USING (k)""")
def value_shares(spark, d):
    """A3."""
    return r6(A.value_shares(X.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k"))


@query("joinability", """WITH a AS (SELECT DISTINCT l_returnflag AS v FROM lineitem), b AS (SELECT DISTINCT o_orderstatus AS v FROM orders)
SELECT '' AS shared_ids, 0 AS shared_time, (SELECT count(*) FROM a) AS n_vocab_a, (SELECT count(*) FROM b) AS n_vocab_b, (SELECT count(*) FROM a JOIN b USING (v)) AS n_vocab_shared, CASE WHEN (SELECT count(*) FROM a JOIN b USING (v)) > 0 THEN 'L2/L3' ELSE 'L4' END AS level""")
def joinability(spark, d):
    """A60."""
    return A.joinability(X.table(spark, d, "lineitem"), X.table(spark, d, "orders"), ["ue_id", "uid"], ["ts", "l_shipdate"], ("l_returnflag", "o_orderstatus"))


@query("byte_minima", f"""WITH {ZEEK} SELECT lower(proto0) AS proto, count(*) AS n, round(min(src_bytes / src_pkts), 6) AS min, round(quantile_cont(src_bytes / src_pkts, 0.5), 6) AS median FROM zk WHERE src_pkts > 0 GROUP BY 1 HAVING count(*) >= 100""")
def byte_minima(spark, d):
    """A40."""
    return r6(A.byte_minima(X.zeek_flows(spark, d), "proto", "src_ip_bytes", "src_pkts"))


# ---------------------------------------------------------- label conflicts
CONTENT = ["l_quantity", "l_discount", "l_tax", "l_linestatus"]
CC = ", ".join(CONTENT)
MIX = f"""{LI}, g AS (SELECT {CC}, count(*) AS n, sum(y) AS n1, count(*) - sum(y) AS n0 FROM li GROUP BY {CC}), m AS (SELECT {CC} FROM g WHERE n1 > 0 AND n0 > 0)"""


@query("conflict_ceiling", f"""WITH {MIX}, t AS (SELECT sum(n1) AS s1, sum(n0) AS s0 FROM g), p AS (SELECT g.*, (n1 / s1::DOUBLE > n0 / s0::DOUBLE)::INT AS p, (n1 > 0 AND n0 > 0)::INT AS mx FROM g, t),
a AS (SELECT count(*) AS n_distinct, sum(mx)::BIGINT AS n_conflicting_records, sum(mx * n)::BIGINT AS fl, sum(n) AS n, sum(n1) AS n1, sum(n0) AS n0, sum(mx * n1) AS m1, sum(mx * n0) AS m0, sum(p * n1) AS tp, sum((1 - p) * n0) AS tn FROM p)
SELECT n_distinct, n_conflicting_records, fl AS flows_in_conflicting, round(fl / n::DOUBLE, 6) AS share_in_conflicting, round(m0 / n0::DOUBLE, 6) AS benign_share_in_conflicting, round(m1 / n1::DOUBLE, 6) AS attack_share_in_conflicting,
  round(tp / n1::DOUBLE, 6) AS ceiling_tpr, round(tn / n0::DOUBLE, 6) AS ceiling_tnr, round((tp / n1::DOUBLE + tn / n0::DOUBLE) / 2, 6) AS ba_ceiling FROM a""")
def conflict_ceiling(spark, d):
    """A25."""
    return r6(A.conflict_ceiling(X.lineitem(spark, d), CONTENT))


@query("conflict_twins", f"""WITH {MIX} SELECT "file", count(*) AS n, count(*) FILTER (WHERE y = 0 AND m.l_quantity IS NOT NULL) AS copies FROM li LEFT JOIN m USING ({CC}) GROUP BY "file\"""")
def conflict_twins(spark, d):
    """J3, P24."""
    t = A.flag_twins(X.lineitem(spark, d).select("file", "y", *CONTENT), CONTENT)
    return t.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_copy").alias("copies"))


@query("conflicts_per_file", f"""WITH {MIX}, r AS (SELECT li.*, (m.l_quantity IS NOT NULL)::INT AS mx FROM li LEFT JOIN m USING ({CC})), k AS (SELECT "file", category, count(*) AS c FROM li WHERE category <> 'benign' GROUP BY ALL),
md AS (SELECT "file", arg_min(category, (-c, category)) AS attack_type FROM k GROUP BY "file")
SELECT "file", count(*) AS n, round(avg(y), 6) AS attack_share, max(attack_type) AS attack_type, round(avg(mx), 6) AS conflicting, round(avg(mx) FILTER (WHERE y = 0), 6) AS benign_conflicting FROM r JOIN md USING ("file") GROUP BY "file\"""")
def conflicts_per_file(spark, d):
    """A26."""
    m = A.mark_mixed(X.lineitem(spark, d).select("file", "y", "category", *CONTENT), CONTENT)
    return r6(A.conflicts_per_file(m, "file", "y", "category", "mixed", "benign"))


@query("pair_conflicts_between_files", f"""WITH {LI}, g AS (SELECT {CC}, "file", count(*) - sum(y) AS n0, sum(y) AS n1 FROM li GROUP BY {CC}, "file"), p AS (SELECT b."file" AS f_b, a."file" AS f_a, b.n0 AS benign, a.n1 AS attack FROM g b JOIN g a USING ({CC}) WHERE b.n0 > 0 AND a.n1 > 0 AND b."file" <> a."file")
SELECT f_b, f_a, count(*) AS records, sum(benign)::BIGINT AS benign_flows, sum(attack)::BIGINT AS attack_flows, count(*) FILTER (WHERE benign = attack) AS equal_counts, count(*) FILTER (WHERE abs(benign - attack) <= 1) AS within_one FROM p GROUP BY f_b, f_a""")
def pair_conflicts_between_files(spark, d):
    """J4."""
    return A.pair_conflicts_between_files(X.lineitem(spark, d), CONTENT, "file")


@query("top_conflicts", f"""WITH {MIX}, t AS (SELECT * FROM g WHERE n1 > 0 AND n0 > 0 ORDER BY n DESC, {CC} LIMIT 10) SELECT n, n1::BIGINT AS attack, n0::BIGINT AS benign FROM t""")
def top_conflicts(spark, d):
    """A57, T4."""
    return A.top_conflicts(X.lineitem(spark, d), CONTENT, "file", "category").select("n", "attack", "benign")


@query("hosts_by_file", f"""WITH {LI}, c AS (SELECT "file", y, l_suppkey, count(*) AS c FROM li GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY "file", y ORDER BY c DESC, l_suppkey::VARCHAR) AS rk FROM c),
t AS (SELECT "file", y, '{{' || string_agg('"' || l_suppkey || '":' || c, ',' ORDER BY rk) || '}}' AS grp_top FROM r WHERE rk <= 3 GROUP BY "file", y)
SELECT "file", y, count(*) AS n, epoch_us(min(l_shipdate)) AS t_first, epoch_us(max(l_shipdate)) AS t_last, max(grp_top) AS grp_top FROM li JOIN t USING ("file", y) GROUP BY "file", y""")
def hosts_by_file(spark, d):
    """A27, T3."""
    li = X.lineitem(spark, d).withColumn("us", F.unix_micros(F.col("l_shipdate").cast("timestamp")))
    return A.hosts_by_file(li, ["file", "y"], ["grp"], "us")


@query("same_hosts_attacks", f"""WITH {LI}, c AS (SELECT "file", l_suppkey, l_linestatus, count(*) AS benign_copies FROM li WHERE is_copy GROUP BY ALL), a AS (SELECT "file" AS f, l_suppkey, l_linestatus, count(*) AS n FROM li WHERE y = 1 GROUP BY ALL)
SELECT c."file", l_suppkey, l_linestatus, benign_copies, coalesce(sum(n) FILTER (WHERE f <> c."file"), 0)::BIGINT AS attack_flows, count(DISTINCT f) FILTER (WHERE f <> c."file")::INT AS n_files FROM c LEFT JOIN a USING (l_suppkey, l_linestatus) GROUP BY c."file", l_suppkey, l_linestatus, benign_copies""")
def same_hosts_attacks(spark, d):
    """J15."""
    li = X.lineitem(spark, d)
    r = A.same_hosts_attacks(li.filter("is_copy"), li.filter("y = 1"), ["l_suppkey", "l_linestatus"], "file", "category", "l_shipdate")
    return r.select("file", "l_suppkey", "l_linestatus", "benign_copies", "attack_flows", F.size("attack_files").alias("n_files"))


PAIRS = f"""{LI}, lab AS (SELECT "file", least(l_suppkey, l_partkey % 200)::VARCHAR AS lo, greatest(l_suppkey, l_partkey % 200)::VARCHAR AS hi, category, y FROM li), k AS (SELECT "file", lo, hi, category, count(*) AS c FROM lab WHERE category <> 'benign' GROUP BY ALL),
rule AS (SELECT "file", lo, hi, arg_min(category, (-c, category)) AS rt FROM k GROUP BY "file", lo, hi), r AS (SELECT lab.*, coalesce(rt, 'benign') AS rt FROM lab LEFT JOIN rule USING ("file", lo, hi))"""


@query("label_by_pair", f"""WITH {PAIRS} SELECT "file", count(*) AS n, sum(y)::BIGINT AS attack, round(avg(((rt <> 'benign')::INT = y)::INT), 6) AS agree, count(DISTINCT CASE WHEN rt <> 'benign' THEN (lo, hi) END) AS attack_pairs FROM r GROUP BY "file\"""")
def label_by_pair(spark, d):
    """J8, P26."""
    li = X.lineitem(spark, d).withColumn("a", F.col("l_suppkey")).withColumn("b", F.pmod("l_partkey", F.lit(200)))
    r = A.label_by_pair(li.select("file", "y", "a", "b", "category"), li.select("file", "a", "b", "category"), "file", "a", "b", "category", "benign")
    return r6(A.rule_agreement(r, "file", "y", "benign"))


@query("capture_summary", f"""WITH {LI} SELECT "file", count(*) AS flows, sum(y)::BIGINT AS attack, sum(is_copy::INT)::BIGINT AS copies, count(*) FILTER (WHERE l_linestatus = 'O') AS published_flows, sum(y) FILTER (WHERE l_linestatus = 'O')::BIGINT AS published_attack FROM li GROUP BY "file\"""")
def capture_summary(spark, d):
    """A62."""
    li = X.lineitem(spark, d)
    return A.capture_summary(li, li.filter("l_linestatus = 'O'"), "file", "y", "is_copy")


@query("match_files", f"""WITH {LI}, c AS (SELECT "file", grp, count(*) AS c FROM li WHERE y = 1 GROUP BY ALL), n AS (SELECT "file", count(*) AS n FROM li GROUP BY "file"), s AS (SELECT "file", arg_min(grp, (-c, grp)) AS attacker FROM c GROUP BY "file")
SELECT a."file" AS file_a, n, attacker, a."file" AS file_b FROM n a JOIN s USING ("file")""")
def match_files(spark, d):
    """The files of a release against themselves under new names."""
    li = X.lineitem(spark, d)
    return A.match_files(li, li, "file", "grp")


@query("corrected_labels", f"""WITH {LI} SELECT row_id, "file", category AS label_published, 'attack_flood' AS label_corrected FROM li WHERE is_copy""")
def corrected_labels(spark, d):
    """P32."""
    li = X.lineitem(spark, d)
    A.assert_all(li.filter("is_copy"), benign=F.col("y") == 0, rule=(F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1))
    return A.corrected_labels(li, "is_copy", "row_id", ["file"], "category", "attack_flood")


@query("align_by_position", """SELECT count(*) AS n, count(*)::BIGINT AS aligned FROM orders""")
def align_by_position(spark, d):
    """J7."""
    o = X.table(spark, d, "orders")
    a = J.align_by_position(o.select("o_orderkey", "o_totalprice"), o.select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderkey", ["o_totalprice"], False)
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_if("aligned").alias("aligned"))


@query("multiset_difference", f"""WITH {LI}, a AS (SELECT l_linenumber, l_tax FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_linenumber, l_tax FROM lineitem WHERE l_returnflag <> 'R'),
j AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) SELECT l_linenumber, l_tax, sum(s)::BIGINT AS surplus FROM j GROUP BY ALL HAVING sum(s) <> 0""")
def multiset_difference(spark, d):
    """J18, U5."""
    li = X.table(spark, d, "lineitem").select("l_linenumber", "l_tax", "l_returnflag")
    return J.multiset_difference(li.filter("l_returnflag = 'R'").drop("l_returnflag"), li.filter("l_returnflag <> 'R'").drop("l_returnflag"))


@query("pair_runs", """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'UNPAIRED_NO_PCAP' WHEN b.k IS NULL THEN 'UNPAIRED_NO_TELEMETRY' ELSE 'PAIRED' END AS status FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer) b ON a.k = b.k""")
def pair_runs(spark, d):
    """J12."""
    a = X.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return J.pair_runs(a, X.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k").select("k", "status")


@query("resume_todo", """SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def resume_todo(spark, d):
    """S15."""
    from ..sources.sinks import todo_left
    done = X.table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return todo_left(X.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), done, ["k"])


# -------------------------------------------------------------- groupings
ASSOC = """ct AS (SELECT g AS a, c AS b, count(*)::DOUBLE AS n FROM src GROUP BY g, c), ma AS (SELECT a, sum(n) AS na FROM ct GROUP BY a), mb AS (SELECT b, sum(n) AS nb FROM ct GROUP BY b), t AS (SELECT sum(n) AS nn FROM ct),
mi AS (SELECT sum(n / nn * ln(n * nn / (na * nb))) AS mi, sum(n * n / (na * nb)) AS phi FROM ct JOIN ma USING (a) JOIN mb USING (b), t),
h AS (SELECT (SELECT -sum(na / nn * ln(na / nn)) FROM ma, t) AS ha, (SELECT -sum(nb / nn * ln(nb / nn)) FROM mb, t) AS hb, (SELECT count(*) FROM ma) AS ra, (SELECT count(*) FROM mb) AS rb),
pu AS (SELECT sum(m) AS modal FROM (SELECT max(n) AS m FROM ct GROUP BY a))
SELECT round(mi / ((ha + hb) / 2), 6) AS nmi, round(sqrt(greatest(phi - 1, 0) / (least(ra, rb) - 1)), 6) AS cramers_v, round(modal / nn, 6) AS purity FROM mi, h, pu, t"""


@query("grouping_alignment", f"WITH {LI}, src AS (SELECT grp AS g, category AS c FROM li), {ASSOC}")
def grouping_alignment(spark, d):
    """A28-A30."""
    return r6(A.association(A.contingency(X.lineitem(spark, d), "grp", "category")))


@query("grouping_concentration", f"""WITH {LI}, s AS (SELECT grp, count(*) AS s FROM li GROUP BY grp), r AS (SELECT s, row_number() OVER (ORDER BY s) AS i, row_number() OVER (ORDER BY s DESC) AS k, count(*) OVER () AS g, sum(s) OVER () AS n FROM s)
SELECT max(g) AS n_groups, round(max(s) / max(n)::DOUBLE, 6) AS largest_group_share, round(sum(s) FILTER (WHERE k <= 5) / max(n)::DOUBLE, 6) AS top5_share, round(sum((2 * i - g - 1) * s / n::DOUBLE) / max(g), 6) AS gini FROM r""")
def grouping_concentration(spark, d):
    """A31."""
    return r6(A.concentration(X.lineitem(spark, d), "grp"))


@query("attacker_coverage", f"""WITH {LI}, g AS (SELECT grp, count(*) AS n, sum(y) AS n1 FROM li GROUP BY grp) SELECT count(*) AS addresses, count(*) FILTER (WHERE n1 = n) AS attack_only, count(*) FILTER (WHERE n1 > 0 AND n1 < n) AS mixed,
  count(*) FILTER (WHERE n1 = 0) AS benign_only, round(max(n) / sum(n)::DOUBLE, 6) AS largest_share FROM g""")
def attacker_coverage(spark, d):
    """A42."""
    return r6(A.attacker_coverage(X.lineitem(spark, d), "grp"))


@query("attackers_per_category", f"""WITH {LI}, c AS (SELECT category, grp, count(*) AS s FROM li WHERE y = 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS i, sum(s) OVER (w ROWS UNBOUNDED PRECEDING) AS cum, sum(s) OVER (PARTITION BY category) AS n FROM c WINDOW w AS (PARTITION BY category ORDER BY s DESC, grp))
SELECT category, max(n)::BIGINT AS flows, count(*)::BIGINT AS attacker_addresses, round(sum(s) FILTER (WHERE i <= 1) / max(n)::DOUBLE, 6) AS top1_share, round(sum(s) FILTER (WHERE i <= 3) / max(n)::DOUBLE, 6) AS top3_share, min(i) FILTER (WHERE cum >= 0.9e0 * n) AS addresses_for_90pct FROM r GROUP BY category""")
def attackers_per_category(spark, d):
    """A42, second part."""
    return r6(A.attackers_per_category(X.lineitem(spark, d).filter("y = 1"), "grp", "category"))


@query("size_matched_groups", f"""WITH {LI}, s AS (SELECT grp, count(*) AS s FROM li GROUP BY grp), z AS (SELECT *, sum(s) OVER (ORDER BY s DESC, grp ROWS UNBOUNDED PRECEDING) AS hi, row_number() OVER (ORDER BY s DESC, grp) - 1 AS fake FROM s),
r AS (SELECT li.*, row_number() OVER (ORDER BY {h("'sm0|' || row_id")}, row_id) AS rk FROM li) SELECT fake AS fake_grp, count(*) AS n, sum(y)::BIGINT AS attacks FROM r JOIN z ON rk > hi - s AND rk <= hi GROUP BY fake""")
def size_matched_groups(spark, d):
    """D16."""
    f = D.size_matched_grouping(X.lineitem(spark, d).select("row_id", "grp", "y"), "grp", "row_id")
    return f.groupBy("fake_grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("attacks"))


PERM = f"""{LI}, rp AS (SELECT unnest(range(20)) AS rep), a AS (SELECT rep, grp, row_number() OVER (PARTITION BY rep ORDER BY {h("'sl0|' || rep || '|' || row_id")}, row_id) AS rk FROM li, rp),
b AS (SELECT rep, y, row_number() OVER (PARTITION BY rep ORDER BY {h("'sl1|' || rep || '|' || row_id")}, row_id) AS rk FROM li, rp), 
s AS (SELECT grp, count(*) AS s FROM li GROUP BY grp), z AS (SELECT *, sum(s) OVER (ORDER BY s DESC, grp ROWS UNBOUNDED PRECEDING) AS hi, row_number() OVER (ORDER BY s DESC, grp) - 1 AS fake FROM s),
fk AS (SELECT li.*, row_number() OVER (ORDER BY {h("'sm0|' || row_id")}, row_id) AS rk FROM li),
ct AS (SELECT rep, grp AS a, y AS b, count(*)::DOUBLE AS n FROM a JOIN b USING (rep, rk) GROUP BY ALL UNION ALL SELECT -1, grp, y, count(*) FROM li GROUP BY ALL
  UNION ALL SELECT -2, fake::VARCHAR, y, count(*) FROM fk JOIN z ON rk > hi - s AND rk <= hi GROUP BY ALL),
ma AS (SELECT rep, a, sum(n) AS na FROM ct GROUP BY rep, a), mb AS (SELECT rep, b, sum(n) AS nb FROM ct GROUP BY rep, b), t AS (SELECT rep, sum(n) AS nn FROM ct GROUP BY rep),
mi AS (SELECT rep, sum(n / nn * ln(n * nn / (na * nb))) AS mi FROM ct JOIN ma USING (rep, a) JOIN mb USING (rep, b) JOIN t USING (rep) GROUP BY rep),
ha AS (SELECT rep, -sum(na / nn * ln(na / nn)) AS ha FROM ma JOIN t USING (rep) GROUP BY rep), hb AS (SELECT rep, -sum(nb / nn * ln(nb / nn)) AS hb FROM mb JOIN t USING (rep) GROUP BY rep),
nm AS (SELECT rep, mi / ((ha + hb) / 2) AS nmi FROM mi JOIN ha USING (rep) JOIN hb USING (rep))"""


@query("permutation_null", f"""WITH {PERM} SELECT round(max(nmi) FILTER (rep = -1), 6) AS nmi, round(avg(nmi) FILTER (rep >= 0), 6) AS nmi_null_mean, round(quantile_cont(nmi, 0.95) FILTER (rep >= 0), 6) AS nmi_null_p95,
  round(max(nmi) FILTER (rep = -1) - avg(nmi) FILTER (rep >= 0), 6) AS nmi_excess_over_null, round(max(nmi) FILTER (rep = -2), 6) AS nmi_sizematched_null, count(*) FILTER (rep >= 0) AS reps FROM nm""")
def permutation_null(spark, d):
    """NMI against that of shuffled labels and of random groups of the same sizes."""
    return r6(A.permutation_null(X.lineitem(spark, d), "grp", "y", "row_id"))


@query("fold_correlations", f"""WITH {LI}, f AS (SELECT grp, "file", avg(y) AS fpr, count(*)::DOUBLE AS n, avg(l_quantity) AS q FROM li GROUP BY ALL), l AS (SELECT "file", 'n' AS predictor, n AS v, fpr FROM f UNION ALL SELECT "file", 'q', q, fpr FROM f)
SELECT "file", predictor, round(corr(v, fpr), 6) AS pearson_r, count(*) AS n, round(corr(v, fpr) * corr(v, fpr), 6) AS r_squared FROM l GROUP BY "file", predictor HAVING count(*) >= 5 AND stddev_samp(fpr) > 0""")
def fold_correlations(spark, d):
    """A32."""
    f = X.lineitem(spark, d).groupBy("grp", "file").agg(F.avg("y").alias("fpr"), F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q"))
    return r6(I.correlations(f, ["file"], "fpr", ["n", "q"]))


# ------------------------------------------------------------------ splits
GS = f"{LI}, g AS (SELECT grp, count(*) AS n, sum(y) AS n1 FROM li GROUP BY grp), sd AS (SELECT unnest([101, 102, 103, 104]) AS split_seed)"


def _groups(spark, d, category=None):
    return D.group_summary(X.lineitem(spark, d), "grp", "y", category)


@query("split_random", f"""WITH {LI}, sd AS (SELECT unnest([101, 102]) AS split_seed), r AS (SELECT split_seed, y, grp, row_number() OVER (PARTITION BY split_seed ORDER BY {h("'rs|' || split_seed || '|' || row_id")}, row_id) AS rk, count(*) OVER (PARTITION BY split_seed) AS n FROM li, sd),
s AS (SELECT *, CASE WHEN rk <= floor(n * (1.0e0 - 0.2e0)) THEN 'train' ELSE 'test' END AS side FROM r)
SELECT split_seed, count(*) FILTER (WHERE side = 'train') AS n_train, count(*) FILTER (WHERE side = 'test') AS n_eval, count(DISTINCT grp) FILTER (WHERE side = 'train') AS n_train_groups, count(DISTINCT grp) FILTER (WHERE side = 'test') AS n_test_groups,
  round(avg(y) FILTER (WHERE side = 'train'), 6) AS train_prevalence, round(avg(y) FILTER (WHERE side = 'test'), 6) AS test_prevalence FROM s GROUP BY split_seed""")
def split_random(spark, d):
    """D2."""
    return r6(D.split_stats(D.random_split(X.lineitem(spark, d).select("row_id", "grp", "y"), [101, 102], "row_id")))


GROUPS = f"""{GS}, o AS (SELECT split_seed, grp, n, n1, sum(n) OVER (PARTITION BY split_seed ORDER BY {h("'gd|' || split_seed || '|' || grp")}, grp ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY split_seed ORDER BY {h("'gd|' || split_seed || '|' || grp")}, grp) AS rk FROM g, sd),
gs AS (SELECT split_seed, grp, n, n1, CASE WHEN cum - n < floor((SELECT sum(n) FROM g) * 0.2e0) OR rk <= 2 THEN 'test' ELSE 'train' END AS side FROM o)"""


@query("split_group", f"WITH {GROUPS} SELECT split_seed, grp, side FROM gs")
def split_group(spark, d):
    """D3, plain form."""
    return D.group_disjoint_split(_groups(spark, d), X.SEEDS).select("split_seed", "grp", "side")


@query("split_group_balanced", f"""WITH RECURSIVE {GS}, t AS (SELECT sum(n)::BIGINT AS n, sum(n1) / sum(n)::DOUBLE AS share, floor(sum(n) * 0.2e0) AS target FROM g),
o AS (SELECT split_seed, grp, n, n1, row_number() OVER (PARTITION BY split_seed ORDER BY {h("'gd|' || split_seed || '|' || grp")}, grp) AS i FROM g, sd),
w AS (SELECT split_seed, []::VARCHAR[] AS picked, 0::BIGINT AS n, 0::BIGINT AS n1 FROM sd UNION ALL
  SELECT split_seed, list_append(any_value(picked), arg_min(grp, (err, i))), (any_value(wn) + arg_min(n, (err, i)))::BIGINT, (any_value(wn1) + arg_min(n1, (err, i)))::BIGINT
  FROM (SELECT w.split_seed, picked, w.n AS wn, w.n1 AS wn1, o.grp, o.n, o.n1, o.i, abs((w.n1 + o.n1) / (w.n + o.n)::DOUBLE - t.share) AS err,
          row_number() OVER (PARTITION BY w.split_seed ORDER BY o.i) AS rk
        FROM w JOIN o USING (split_seed), t WHERE NOT (w.n >= t.target AND len(picked) >= 2) AND NOT list_contains(picked, o.grp))
  WHERE rk <= 8 GROUP BY split_seed),
l AS (SELECT split_seed, arg_max(picked, len(picked)) AS picked FROM w GROUP BY split_seed)
SELECT split_seed, grp, n, n1, CASE WHEN list_contains(picked, grp) THEN 'test' ELSE 'train' END AS side FROM o JOIN l USING (split_seed)""")
def split_group_balanced(spark, d):
    """D3, balanced form."""
    return D.balanced_group_split(_groups(spark, d), X.SEEDS)


@query("split_stratified", f"""WITH {GS}, k AS (SELECT grp, category, count(*) AS c FROM li GROUP BY ALL), dc AS (SELECT grp, arg_min(category, (-c, category)) AS category FROM k GROUP BY grp),
r AS (SELECT split_seed, grp, category, row_number() OVER (PARTITION BY split_seed, category ORDER BY {h("'sg|' || split_seed || '|' || grp")}, grp) AS rk, count(*) OVER (PARTITION BY split_seed, category) AS m FROM dc, sd)
SELECT split_seed, grp, category, CASE WHEN m > 1 AND rk <= least(greatest(round_even(m * 0.2e0, 0), 1), m - 1) THEN 'test' ELSE 'train' END AS side FROM r""")
def split_stratified(spark, d):
    """D4."""
    return D.stratified_group_split(_groups(spark, d, "category"), X.SEEDS).select("split_seed", "grp", "category", "side")


def _dealt_sql(order: str, loads: str, scale: int, seeds: str) -> str:
    """Group after group to the lightest load: (split_seed, grp, n, n1, j), j from 1."""
    return f"""o AS (SELECT split_seed, grp, n, n1, row_number() OVER (PARTITION BY split_seed ORDER BY {order}, grp) AS i FROM g, {seeds}),
w AS (SELECT split_seed, 0::BIGINT AS i, NULL::VARCHAR AS grp, 0::BIGINT AS n, 0::BIGINT AS n1, {loads} AS loads, 0::BIGINT AS j FROM {seeds}, (SELECT sum(n)::BIGINT AS t FROM g) UNION ALL
  SELECT split_seed, o.i, o.grp, o.n, o.n1::BIGINT, list_transform(w.loads, lambda x, k: x + CASE WHEN k = list_position(w.loads, list_min(w.loads)) THEN {scale} * o.n ELSE 0 END),
    list_position(w.loads, list_min(w.loads))
  FROM w JOIN o USING (split_seed) WHERE o.i = w.i + 1)"""


@query("split_three_way", f"""WITH RECURSIVE {GS}, {_dealt_sql(h("'tw|' || split_seed || '|' || n") + ", n, " + h("'tw|' || split_seed || '|' || grp"), "[-3 * t, -t, -t]", 5, "sd")}
SELECT split_seed, grp, n, n1, ['train', 'calibration', 'test'][j] AS side FROM w WHERE i > 0""")
def split_three_way(spark, d):
    """D5."""
    return D.three_way_group_split(_groups(spark, d), X.SEEDS)


@query("group_k_fold", f"""WITH RECURSIVE {GS}, {_dealt_sql("-n, " + h("'kf|' || grp"), "[0::BIGINT, 0, 0, 0, 0]", 1, "(SELECT 0 AS split_seed)")}
SELECT grp, n, n1, j - 1 AS fold FROM w WHERE i > 0""")
def group_k_fold(spark, d):
    """D10."""
    return D.group_k_fold(_groups(spark, d), 5)


@query("leakage_guard", f"""WITH {LI}, a AS (SELECT 101 AS split_seed, grp, CASE WHEN l_linestatus = 'O' THEN 'train' ELSE 'test' END AS side FROM li) SELECT split_seed, grp, count(DISTINCT side) AS n_sides FROM a GROUP BY ALL HAVING count(DISTINCT side) > 1""")
def leakage_guard(spark, d):
    """A forced overlap is listed."""
    a = X.lineitem(spark, d).select(F.lit(101).alias("split_seed"), "grp", F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("side"))
    return D.overlapping_groups(a)


@query("split_coverage", f"""WITH {GROUPS}, r AS (SELECT split_seed, side, category, li.grp FROM li JOIN gs USING (grp)), c AS (SELECT split_seed, category, count(*) FILTER (WHERE side = 'train') AS train_flows, count(*) FILTER (WHERE side = 'test') AS test_flows,
  count(DISTINCT grp) FILTER (WHERE side = 'train') AS train_groups, count(DISTINCT grp) FILTER (WHERE side = 'test') AS test_groups FROM r GROUP BY split_seed, category)
SELECT *, round(train_flows / (train_flows + test_flows)::DOUBLE, 6) AS train_share, (train_flows = 0 OR test_flows = 0)::INT AS missing FROM c""")
def split_coverage(spark, d):
    """A43."""
    rows = D.apply_split(X.lineitem(spark, d).select("grp", "category"), D.group_disjoint_split(_groups(spark, d), X.SEEDS), "grp")
    return r6(A.split_coverage(rows, "split_seed", "category", "grp"))


@query("subsample", f"""WITH {LI} SELECT row_id FROM li ORDER BY {h("'sub7|' || row_id")}, row_id LIMIT 3000""")
def subsample(spark, d):
    """D1, T7."""
    return D.subsample(X.lineitem(spark, d).select("row_id"), 3000, 7, "row_id")


@query("stratified_random_split", f"""WITH {LI}, r AS (SELECT y, row_id, row_number() OVER (PARTITION BY y ORDER BY {h("'sr3|' || row_id")}, row_id) AS rk, count(*) OVER (PARTITION BY y) AS n FROM li)
SELECT row_id, CASE WHEN rk <= round_even(n * 0.3e0, 0) THEN 'test' ELSE 'train' END AS side FROM r""")
def stratified_random_split(spark, d):
    """D15."""
    return D.stratified_random_split(X.lineitem(spark, d).select("row_id", "y"), "row_id", 3).select("row_id", "side")


@query("file_draw", f"""WITH f AS (SELECT DISTINCT s_suppkey AS "file" FROM supplier), g AS (SELECT unnest([1, 2, 4]) AS k), w AS (SELECT unnest([0, 1, 2, 3]) AS draw),
r AS (SELECT "file", k, draw, row_number() OVER (PARTITION BY k, draw ORDER BY {h("'fd|' || k || '|' || draw || '|' || \"file\"")}, "file") AS rk FROM f, g, w) SELECT "file", k, draw, CASE WHEN rk <= k THEN 'labelled' ELSE 'held_out' END AS side FROM r""")
def file_draw(spark, d):
    """D7, U6."""
    return D.file_draw(X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("file")), [1, 2, 4], 4)


@query("leave_one_group_out", f"""WITH {LI} SELECT "file" AS unit, count(*) AS n_test, sum(y)::BIGINT AS test_attacks, (SELECT count(*) FROM li) - count(*) AS n_train, ((SELECT sum(y) FROM li) - sum(y))::BIGINT AS train_attacks, (sum(y) = 0 OR sum(y) = count(*))::INT AS single_class FROM li GROUP BY "file\"""")
def leave_one_group_out(spark, d):
    """D8."""
    return D.leave_one_group_out(X.lineitem(spark, d), "file")


@query("station_split", f"""WITH {LI} SELECT direction, CASE WHEN ("file" > 3) = (direction = 's1_to_s2') THEN 'test' ELSE 'train' END AS side, count(*) AS n FROM li, (SELECT unnest(['s1_to_s2', 's2_to_s1']) AS direction) GROUP BY ALL""")
def station_split(spark, d):
    """D9."""
    return D.station_split(X.lineitem(spark, d), "file", 3).groupBy("direction", "side").agg(F.count(F.lit(1)).alias("n"))


@query("label_efficient_pool", f"""WITH {LI}, s AS (SELECT row_id, y FROM li WHERE l_linestatus = 'O'), t AS (SELECT row_id, CASE WHEN is_copy THEN 1 ELSE y END AS y FROM li WHERE l_linestatus = 'F' ORDER BY {h("'sub5|' || row_id")}, row_id LIMIT 2000),
p AS (SELECT 'source+k' AS variant, y FROM s UNION ALL SELECT 'source+k', y FROM t) SELECT variant, count(*) AS n, sum(y)::BIGINT AS attacks FROM p GROUP BY variant""")
def label_efficient_pool(spark, d):
    """D19."""
    li = X.lineitem(spark, d).select("row_id", "y", "is_copy", "l_linestatus")
    p = D.label_efficient_pool(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'"), "source+k", 5, "row_id", n_with_source=2000)
    return p.agg(F.lit("source+k").alias("variant"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("attacks"))


# ------------------------------------------------------------ perturbation
PERT = f"{ZEEK}, ft AS (SELECT row_id, y, l_orderkey, {shared_sql(False)} FROM base)"


def _features(spark, d, extra=()):
    z = X.zeek_flows(spark, d)
    return SP.shared_from_zeek(z, ["row_id", "y", *extra])


@query("perturb_scale", f"WITH {PERT} SELECT row_id, round(CASE WHEN y = 1 THEN tot_bytes * (1.0e0 + 0.25e0) ELSE tot_bytes END, 6) AS tot_bytes FROM ft")
def perturb_scale(spark, d):
    """R4."""
    return r6(R.attack(_features(spark, d), "scaling_attack", 0.25, 1, "row_id").select("row_id", "tot_bytes"))


@query("perturb_stale", f"""WITH {PERT}, o AS (SELECT row_id, duration, lag(duration) OVER (ORDER BY l_orderkey, row_id) AS prev, row_number() OVER (ORDER BY {h("'stale_telemetry1|' || row_id")}, row_id) AS rk, count(*) OVER () AS n FROM ft)
SELECT row_id, round(CASE WHEN rk <= greatest(round_even(n * 0.25e0, 0), 1) AND prev IS NOT NULL THEN prev ELSE duration END, 6) AS duration FROM o""")
def perturb_stale(spark, d):
    """R3, W18."""
    z = X.zeek_flows(spark, d, stored=True).withColumn("ok", F.split_part("row_id", F.lit("-"), F.lit(1)).cast("long"))
    f = SP.shared_from_zeek(z, ["row_id", "y", "ok"])
    return r6(R.attack(f, "stale_telemetry", 0.25, 1, "row_id", order=["ok", "row_id"]).select("row_id", "duration"))


@query("perturb_missing", f"WITH {PERT} SELECT count(*) AS n, 4 AS zeroed FROM ft")
def perturb_missing(spark, d):
    """R2: round(0.25 · 14) = 4 columns are emptied."""
    f = R.attack(_features(spark, d), "missing_telemetry", 0.25, 1, "row_id")
    cols = [c for c in SP.SHARED_COLUMNS if c not in SP.PROTO_COLUMNS]
    zero = S.row_total([(F.max(F.abs(c)) == 0).cast("int") for c in cols])
    return f.agg(F.count(F.lit(1)).alias("n"), zero.alias("zeroed"))


@query("perturb_evasion", f"""WITH {PERT}, sc AS (SELECT stddev_samp(duration) AS sd FROM ft)
SELECT row_id, round(CASE WHEN y = 1 THEN duration + {u("'evasion_constrained1|duration|' || row_id")} * (0.1e0 * sd) ELSE duration END, 6) AS duration FROM ft, sc""")
def perturb_evasion(spark, d):
    """R6."""
    return r6(R.attack(_features(spark, d), "evasion_constrained", 0.1, 1, "row_id").select("row_id", "duration"))


@query("perturb_evasion_free", f"""WITH {PERT}, sc AS (SELECT stddev_samp(duration) AS sd FROM ft)
SELECT row_id, round(CASE WHEN y = 1 THEN duration + (2e0 * {u("'evasion_unconstrained1|duration|' || row_id")} - 1e0) * (0.1e0 * sd) ELSE duration END, 6) AS duration FROM ft, sc""")
def perturb_evasion_free(spark, d):
    """R5."""
    return r6(R.attack(_features(spark, d), "evasion_unconstrained", 0.1, 1, "row_id").select("row_id", "duration"))


@query("perturb_noise", f"""WITH {PERT}, sc AS (SELECT stddev_samp(duration) AS sd FROM ft)
SELECT row_id, round(duration + sqrt(-2e0 * ln(({h("'n1|gaussian_noise1|duration|' || row_id")} + 1e0) / 4294967297e0)) * cos(2e0 * 3.141592653589793e0 * {u("'n2|gaussian_noise1|duration|' || row_id")}) * (0.1e0 * sd), 6) AS duration FROM ft, sc""")
def perturb_noise(spark, d):
    """R1."""
    return r6(R.attack(_features(spark, d), "gaussian_noise", 0.1, 1, "row_id").select("row_id", "duration"))


@query("poison_labels", f"""WITH {LI}, r AS (SELECT row_id, y, row_number() OVER (ORDER BY {h("'poison|' || row_id")}, row_id) AS rk, count(*) OVER () AS n FROM li) SELECT row_id, CASE WHEN rk <= round_even(n * 0.1e0, 0) THEN 1 - y ELSE y END AS y FROM r""")
def poison_labels(spark, d):
    """R7."""
    return R.poison_labels(X.lineitem(spark, d).select("row_id", "y"), 0.1, "poison", "row_id")


# -------------------------------------------------------------------- shift
@query("anova_f", f"""WITH {PERT}, g AS (SELECT y, count(*) AS n, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) AS v_{c}' for c in ('duration', 'src_bytes', 'tot_pkts', 'bytes_per_s'))} FROM ft GROUP BY y),
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, n, m_{c} AS m, v_{c} AS v FROM g" for c in ('duration', 'src_bytes', 'tot_pkts', 'bytes_per_s'))}), mu AS (SELECT feature, sum(n * m) / sum(n) AS mu FROM l GROUP BY feature)
SELECT feature, round((sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) AS f FROM l JOIN mu USING (feature) GROUP BY feature""")
def anova_f(spark, d):
    """A35."""
    f = SH.anova_f(_features(spark, d), ["duration", "src_bytes", "tot_pkts", "bytes_per_s"])
    return f.select("feature", F.round("f", 4).alias("f"))


TWO = f"""WITH z AS (WITH {ZEEK} SELECT {shared_sql(False)} FROM base), a AS (WITH {ARGUS} SELECT {shared_sql(False)} FROM base)"""
_SC = ["duration", "tot_bytes", "mean_pkt_size", "src_byte_ratio"]


def _two(spark, d):
    return SP.shared_from_zeek(X.zeek_flows(spark, d)), SP.shared_from_argus(X.argus_flows(spark, d))


@query("wasserstein", f"""{TWO}, un AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS v, 1 AS p, 0 AS q FROM z UNION ALL SELECT '{c}', {c}, 0, 1 FROM a" for c in _SC)}), dv AS (SELECT feature, v, sum(p) AS p, sum(q) AS q FROM un GROUP BY feature, v),
c AS (SELECT feature, v, sum(p) OVER w / (sum(p) OVER t)::DOUBLE AS fa, sum(q) OVER w / (sum(q) OVER t)::DOUBLE AS fb, lead(v) OVER (PARTITION BY feature ORDER BY v) AS nv FROM dv WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY feature))
SELECT feature, round(sum(abs(fa - fb) * (nv - v)), 6) AS w1 FROM c GROUP BY feature""")
def wasserstein(spark, d):
    """A36."""
    z, a = _two(spark, d)
    return r6(SH.wasserstein1(SH.melt(z, _SC), SH.melt(a, _SC)))


@query("domain_auc", f"""{TWO}, un AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS v, 0 AS d FROM z UNION ALL SELECT '{c}', {c}, 1 FROM a" for c in _SC)}), t AS (SELECT feature, v, count(*) FILTER (WHERE d = 1) AS p, count(*) FILTER (WHERE d = 0) AS n FROM un GROUP BY feature, v),
c AS (SELECT feature, p, n, sum(n) OVER (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING) - n AS below, sum(p) OVER (PARTITION BY feature) AS np, sum(n) OVER (PARTITION BY feature) AS nn FROM t), au AS (SELECT feature, sum(p * (below + 0.5e0 * n)) / (max(np)::DOUBLE * max(nn)) AS auc FROM c GROUP BY feature),
md AS (SELECT feature, quantile_cont(v, 0.5) FILTER (WHERE d = 0) AS ma, quantile_cont(v, 0.5) FILTER (WHERE d = 1) AS mb FROM un GROUP BY feature)
SELECT feature, round(greatest(auc, 1 - auc), 6) AS domain_auc, round(ma, 6) AS median_a, round(mb, 6) AS median_b FROM au JOIN md USING (feature)""")
def domain_auc(spark, d):
    """A38."""
    z, a = _two(spark, d)
    return r6(SH.univariate_domain_auc(z, a, _SC))


@query("quantile_map", None)
def quantile_map(spark, d):
    """A37 and A36 on mapped values."""
    z, a = _two(spark, d)
    grid = SH.quantile_map(z, _SC)
    qa, qb = SH.apply_quantile_map(z.select(*_SC), grid), SH.apply_quantile_map(a.select(*_SC), grid)
    return r6(SH.wasserstein1(SH.melt(qa, _SC), SH.melt(qb, _SC)))


@query("covariance", f"""WITH {PERT} {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}) / ((stddev_pop({a}) + 1e-9) * (stddev_pop({b}) + 1e-9)) + {1 if a == b else 0}, 6) AS cov FROM ft" for i, a in enumerate(_SC) for b in _SC[i:])}""")
def covariance(spark, d):
    """A39."""
    return r6(SH.covariance(_features(spark, d), _SC))
