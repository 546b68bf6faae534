"""Audits: profile, groupings, duplicates with conflicting labels, coverage of splits."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ordered as O
from ..functions import scalars as S
from ..session import shuffles_dropped
from . import space as SP
from . import splits as D

MIN_FOLDS = 5                # Fixed value: folds a group key has to support.


# ------------------------------------------------------------------ profile
def profile(df: DataFrame) -> DataFrame:
    """A1. Per column: type, NULL rate; with the table's rows and exact duplicates."""
    cols = df.columns
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    r = g.agg(F.sum("_c").alias("n_rows"), (F.sum("_c") - F.count(F.lit(1))).alias("exact_duplicate_rows"),
              *[F.sum(F.when(F.col(c).isNull(), F.col("_c")).otherwise(0)).alias(f"_n_{c}") for c in cols])
    types = dict(df.dtypes)
    per = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                             F.col(f"_n_{c}").alias("nulls")) for c in cols])
    out = r.select("n_rows", "exact_duplicate_rows", F.explode(per).alias("_p"))
    return out.select("_p.column", "_p.dtype", "n_rows",
                      (100.0 * F.col("_p.nulls") / F.col("n_rows")).alias("null_pct"), "exact_duplicate_rows",
                      (100.0 * F.col("exact_duplicate_rows") / F.col("n_rows")).alias("exact_duplicate_pct"))


def group_key_feasibility(df: DataFrame, keys: list[str]) -> DataFrame:
    """A2. Groups, NULL share, largest share and the verdict of each candidate key.

    All present keys are counted in one pass over (key name, value).
    """
    have = [k for k in keys if k in df.columns]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v"))
                                         for k in have])).alias("x")).select("x.key", "x.v")
    c = long.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("v").isNotNull()
    g = c.groupBy("key").agg(F.count_if(real).alias("n_groups"),
                             (100.0 * F.sum(F.when(~real, F.col("n")).otherwise(0)) / F.sum("n")).alias("null_pct"),
                             (F.max(F.when(real, F.col("n"))) / F.sum("n")).alias("largest_group_share"))
    n = F.col("n_groups")
    g = g.withColumn("verdict", F.when(n < MIN_FOLDS, "TOO FEW").when(n < 2 * MIN_FOLDS, "TIGHT")
                     .when(F.col("largest_group_share") > 0.5, "IMBALANCED").otherwise("OK"))
    gone = [k for k in keys if k not in have]
    if gone:
        a = F.explode(F.array(*[F.lit(k) for k in gone]))
        absent = df.sparkSession.range(1).select(a.alias("key"), F.lit("ABSENT").alias("verdict"))
        g = g.unionByName(absent, allowMissingColumns=True)
    return g


def value_shares(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """A3. Shares of a label in two tables in percent and their absolute difference."""
    def share(d: DataFrame, name: str) -> DataFrame:
        c = d.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        return c.select(col, (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias(name))
    j = share(a, "a_pct").join(share(b, "b_pct"), col, "full_outer")
    j = j.withColumn("a_pct", F.coalesce("a_pct", F.lit(0.0))).withColumn("b_pct", F.coalesce("b_pct", F.lit(0.0)))
    return j.withColumn("abs_diff", F.abs(F.col("a_pct") - F.col("b_pct")))


def joinability(a: DataFrame, b: DataFrame, ids: list[str], times: list[str], vocab: tuple[str, str]) -> DataFrame:
    """A60. Level of a possible join: shared id L0, time on both sides L1, vocabulary L2/L3, none L4."""
    ca, cb = set(a.columns), set(b.columns)
    shared = sorted(set(ids) & ca & cb)
    t = bool(set(times) & ca) and bool(set(times) & cb)
    va, vb = (d.filter(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct()
              for d, c in ((a, vocab[0]), (b, vocab[1])))
    s = va.withColumn("_a", F.lit(1)).join(vb.withColumn("_b", F.lit(1)), "v", "full_outer")
    r = s.agg(F.count("_a").alias("n_vocab_a"), F.count("_b").alias("n_vocab_b"),
              F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_vocab_shared"))
    level = F.lit("L0") if shared else F.lit("L1") if t else \
        F.when(F.col("n_vocab_shared") > 0, "L2/L3").otherwise("L4")
    return r.select(F.lit(";".join(shared)).alias("shared_ids"), F.lit(int(t)).alias("shared_time"),
                    "n_vocab_a", "n_vocab_b", "n_vocab_shared", level.alias("level"))


def byte_minima(df: DataFrame, proto: str, nbytes: str, pkts: str, min_rows: int = 100) -> DataFrame:
    """A40. Smallest and median bytes per packet per protocol with enough rows."""
    d = df.filter(F.col(pkts) > 0).select(F.lower(F.col(proto)).alias("proto"), (F.col(nbytes) / F.col(pkts)).alias("_r"))
    g = d.groupBy("proto").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("min")).filter(F.col("n") >= min_rows)
    return g.join(O.exact_percentiles(d, "_r", {"median": 0.5}, ["proto"]), "proto")


def header_share(packets: DataFrame, keys: list[str] = ("file",)) -> DataFrame:
    """A41. Share of frames whose length exceeds the IP length by one Ethernet header."""
    hit = (F.col("frame_len") - F.col("ip_len") == SP.ETHERNET_BYTES).cast("int")
    return packets.groupBy(*keys, "datalink").agg(F.count(F.lit(1)).alias("ipv4_frames"),
                                                  F.sum(hit).alias("header_14"), F.avg(hit).alias("share"))


# --------------------------------------------------------- label conflicts
def content_counts(df: DataFrame, cols: list[str], y: str = "y", extra: list[str] = ()) -> DataFrame:
    """Rows and attacks per distinct content (doubles rounded to 9 places).

    Group equality is on the columns themselves. The aggregate is partial, so a record that
    repeats in a third of all rows reaches the shuffle as one row per task.
    """
    types = dict(df.dtypes)
    k = [F.bround(c, 9).alias(c) if types[c] in ("double", "float") else F.col(c) for c in cols]
    return df.select(*k, *extra, F.col(y).alias("_y")).groupBy(*cols, *extra).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n1"))


def conflict_ceiling(df: DataFrame, cols: list[str], y: str = "y") -> DataFrame:
    """A25. In-sample bound of a lookup on distinct records, and the shares in mixed records."""
    g = content_counts(df, cols, y).withColumn("n0", F.col("n") - F.col("n1"))
    tot = g.agg(F.sum("n1").alias("s1"), F.sum("n0").alias("s0"))
    s1, s0 = tot.select("s1").scalar(), tot.select("s0").scalar()
    pred = F.coalesce((S.ratio("n1", s1) > F.coalesce(S.ratio("n0", s0), F.lit(0.0))).cast("int"), F.lit(0))
    mixed = (F.col("n1") > 0) & (F.col("n0") > 0)
    g = g.withColumn("_p", pred).withColumn("_m", mixed.cast("int"))
    r = g.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("_m").alias("n_conflicting_records"),
              F.sum(F.col("_m") * F.col("n")).alias("flows_in_conflicting"),
              F.sum("n").alias("_n"), F.sum("n1").alias("_n1"), F.sum("n0").alias("_n0"),
              F.sum(F.col("_m") * F.col("n1")).alias("_m1"), F.sum(F.col("_m") * F.col("n0")).alias("_m0"),
              F.sum(F.col("_p") * F.col("n1")).alias("_tp"), F.sum((1 - F.col("_p")) * F.col("n0")).alias("_tn"))
    r = (r.withColumn("share_in_conflicting", S.ratio("flows_in_conflicting", "_n"))
         .withColumn("benign_share_in_conflicting", S.ratio("_m0", "_n0"))
         .withColumn("attack_share_in_conflicting", S.ratio("_m1", "_n1"))
         .withColumn("ceiling_tpr", S.ratio("_tp", "_n1")).withColumn("ceiling_tnr", S.ratio("_tn", "_n0")))
    return r.withColumn("ba_ceiling", (F.col("ceiling_tpr") + F.col("ceiling_tnr")) / 2).drop(
        "_n", "_n1", "_n0", "_m1", "_m0", "_tp", "_tn")


def _null_safe(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def flag_twins(df: DataFrame, cols: list[str], y: str = "y", out: str = "is_copy") -> DataFrame:
    """J3. Flag benign rows whose whole content also occurs on an attack row.

    Conflicting contents are found by a partial aggregate and joined back null-safely; a
    content copied into a third of all rows is one row of the small side.
    """
    mixed = df.groupBy(*cols).agg(F.max(y).alias("_hi"), F.min(y).alias("_lo")).filter(
        (F.col("_hi") == 1) & (F.col("_lo") == 0)).select(*[F.col(c).alias(f"_t_{c}") for c in cols], F.lit(True).alias("_tw"))
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in cols])
    d = df.join(mixed, cond, "left")
    return d.withColumn(out, (F.col(y) == 0) & F.col("_tw").isNotNull()).drop(
        "_tw", *[f"_t_{c}" for c in cols])


def mark_mixed(df: DataFrame, cols: list[str], y: str = "y", out: str = "mixed") -> DataFrame:
    """Flag every row of a content that occurs with both labels."""
    d = flag_twins(df, cols, y, "_b")
    inv = flag_twins(d.withColumn("_iy", 1 - F.col(y)), cols, "_iy", "_a")
    return inv.withColumn(out, F.col("_a") | F.col("_b")).drop("_a", "_b", "_iy")


def conflicts_per_file(df: DataFrame, file: str, y: str, kind: str, mixed: str, benign: str = "Benign") -> DataFrame:
    """A26. Size, attack share, modal attack type, and conflict shares per file."""
    m = F.col(mixed).cast("int")
    return df.groupBy(file).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("attack_share"),
        F.coalesce(F.mode(F.when(F.col(kind) != benign, F.col(kind)), True), F.lit("none")).alias("attack_type"),
        F.avg(m).alias("conflicting"), F.avg(F.when(F.col(y) == 0, m)).alias("benign_conflicting"))


#: Attack files of one record that meet its benign files in one task.
FILES_TOGETHER = 64


def pair_conflicts_between_files(df: DataFrame, cols: list[str], file: str, y: str = "y") -> DataFrame:
    """J4. Benign copies in one file against attack copies of the same record in another.

    The join runs on per-(record, file) counts, so a record contributes at most files² rows
    whatever its number of copies. The attack files of a record are dealt into as many lots as
    64 of them fill, and its benign files go to each lot: a record that is in all files is many
    join keys, one in a few files is one.
    """
    lots = F.ceil(F.count_if(F.col("n1") > 0).over(Window.partitionBy(*cols)) / FILES_TOGETHER).cast("int")
    g = content_counts(df, cols, y, [file]).withColumn("n0", F.col("n") - F.col("n1")).withColumn("_lots", lots).filter("_lots > 0")
    b = g.filter(F.col("n0") > 0).select(*cols, F.col(file).alias("f_b"), F.col("n0").alias("benign"), F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)).alias("_lot"))
    a = g.filter(F.col("n1") > 0).select(*[F.col(c).alias(f"_a_{c}") for c in cols], F.col(file).alias("f_a"), F.col("n1").alias("attack"),
                                         F.pmod(F.xxhash64(file), F.col("_lots")).cast("int").alias("_a_lot"))
    cond = reduce(lambda x, z: x & z, [F.col(c).eqNullSafe(F.col(f"_a_{c}")) for c in cols]) & (F.col("_lot") == F.col("_a_lot"))
    p = b.join(a, cond & (F.col("f_b") != F.col("f_a")))
    near = F.abs(F.col("benign") - F.col("attack"))
    return p.groupBy("f_b", "f_a").agg(
        F.count(F.lit(1)).alias("records"), F.sum("benign").alias("benign_flows"),
        F.sum("attack").alias("attack_flows"), F.count_if(near == 0).alias("equal_counts"),
        F.count_if(near <= 1).alias("within_one"))


def top_conflicts(df: DataFrame, cols: list[str], file: str, kind: str, y: str = "y", n: int = 10) -> DataFrame:
    """A57. The n largest mixed records, their counts per file|type and non-zero fields as JSON."""
    g = content_counts(df, cols, y, [file, kind])
    per = g.groupBy(*cols).agg(F.sum("n").alias("_n"), F.sum("n1").alias("_n1")).filter(
        (F.col("_n1") > 0) & (F.col("_n1") < F.col("_n")))
    top = per.orderBy(F.col("_n").desc(), *cols).limit(n)
    t = top.select(*[F.col(c).alias(f"_t_{c}") for c in cols], "_n", "_n1")
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in cols])
    j = g.join(F.broadcast(t), cond)           # n rows, a parameter
    entry = F.struct(F.concat_ws("|", F.col(file).cast("string"), F.col(kind)).alias("key"), F.col("n").alias("value"))
    r = j.groupBy(*cols, "_n", "_n1").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    nz = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))
                                               for c in cols]), lambda e: e["value"] != "0.0"))
    return r.select(F.col("_n").alias("n"), F.col("_n1").alias("attack"), (F.col("_n") - F.col("_n1")).alias("benign"),
                    F.to_json(F.map_from_entries("_e")).alias("by_file_and_type"), F.to_json(nz).alias("nonzero_fields"))


def hosts_by_file(df: DataFrame, keys: list[str], cols: list[str], ts: str, n: int = 3) -> DataFrame:
    """A27, T3. Per (file, group): rows, first and last time, n most frequent values per column as JSON.

    Values are counted with a map-side aggregate; only the n kept ones are gathered.
    """
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v"))
                                                for c in cols])).alias("_x")).select(*keys, "_x.*")
    cnt = long.filter(F.col("v").isNotNull()).groupBy(*keys, "col", "v").agg(F.count(F.lit(1)).alias("c"))
    top = SP.top_n_per_group(cnt, [*keys, "col"], "v", "c", n)
    js = F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "v", "c"))),
                                                  lambda e: F.struct(e["v"].alias("key"), e["c"].alias("value")))))
    wide = top.groupBy(*keys, "col").agg(js.alias("js")).groupBy(*keys).pivot("col", cols).agg(F.first("js"))
    wide = wide.withColumnsRenamed({c: f"{c}_top" for c in cols})
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("t_first"), F.max(ts).alias("t_last"))
    return base.join(wide, keys)


def same_hosts_attacks(copies: DataFrame, attacks: DataFrame, host: list[str], file: str, kind: str,
                       ts: str) -> DataFrame:
    """J15. Benign copies per (file, hosts) against attacks of the same hosts in other files.

    Both sides are counted per (hosts, file) before they meet. The attacks of a pair of hosts
    are one row, with an entry for each file and type, so the join adds no rows; each row of
    copies leaves out its own file.
    """
    c = copies.groupBy(file, *host).agg(F.count(F.lit(1)).alias("benign_copies"), F.min(ts).alias("benign_first"),
                                        F.max(ts).alias("benign_last"))
    a = attacks.groupBy(*host, F.col(file).alias("f"), F.col(kind).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi")) \
        .groupBy(*host).agg(F.collect_list(F.struct("f", "k", "n", "lo", "hi")).alias("_all"))
    entries = F.coalesce("_all", F.array().cast(a.schema["_all"].dataType))
    j = c.join(a, host, "left").withColumn("_other", F.filter(entries, lambda x: x["f"] != F.col(file)))

    def of(name: str) -> Column:
        return F.transform("_other", lambda x: x[name])
    return j.select(file, *host, "benign_copies", "benign_first", "benign_last", F.array_sort(F.array_distinct(of("f"))).alias("attack_files"),
                    F.aggregate("_other", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("attack_flows"),
                    F.array_sort(F.array_compact(F.array_distinct(of("k")))).alias("attack_types"),
                    F.array_min(of("lo")).alias("attack_first"), F.array_max(of("hi")).alias("attack_last"))


def label_by_pair(flows: DataFrame, labelled: DataFrame, file: str, a: str, b: str, kind: str,
                  benign: str = "Benign") -> DataFrame:
    """J8. Attack type of (file, unordered host pair): modal attack type, else benign."""
    p = labelled.filter(F.col(kind) != benign).select(file, SP.unordered_pair(a, b).alias("pair"), kind)
    rule = p.groupBy(file, "pair").agg(F.mode(kind, True).alias("rule_type"))
    d = flows.withColumn("pair", SP.unordered_pair(a, b)).join(rule, [file, "pair"], "left")
    return d.withColumn("rule_type", F.coalesce("rule_type", F.lit(benign)))


def rule_agreement(flows: DataFrame, file: str, y: str, benign: str = "Benign") -> DataFrame:
    """J8. Agreement of the pair rule with the given labels per file."""
    hit = (F.col("rule_type") != benign).cast("int")
    return flows.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("attack"),
                                   F.avg((hit == F.col(y)).cast("int")).alias("agree"),
                                   F.count_distinct(F.when(hit == 1, F.col("pair"))).alias("attack_pairs"))


def capture_summary(flows: DataFrame, published: DataFrame, file: str, y: str, copy: str) -> DataFrame:
    """A62. Flows, attacks and copies per capture beside the published counts."""
    a = flows.groupBy(file).agg(F.count(F.lit(1)).alias("flows"), F.sum(y).alias("attack"),
                                F.sum(F.col(copy).cast("int")).alias("copies"))
    b = published.groupBy(file).agg(F.count(F.lit(1)).alias("published_flows"), F.sum(y).alias("published_attack"))
    return a.join(b, file, "left")


def match_files(a: DataFrame, b: DataFrame, file: str, src: str, y: str = "y") -> DataFrame:
    """J11. Files of two releases that have the same size and the same top attacker."""
    def sig(d: DataFrame, name: str) -> DataFrame:
        n = d.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
        c = d.filter(F.col(y) == 1).groupBy(file, src).agg(F.count(F.lit(1)).alias("_c"))
        t = c.groupBy(file).agg(F.min(F.struct((-F.col("_c")).alias("o"), F.col(src).alias("s"))).alias("_t"))
        return n.join(t, file, "left").select(F.col(file).alias(name), "n",
                                              F.coalesce(F.col("_t.s").cast("string"), F.lit("")).alias("attacker"))
    return sig(a, "file_a").join(sig(b, "file_b"), ["n", "attacker"], "left")


def corrected_labels(df: DataFrame, copy: str, row_id: str, keep: list[str], label: str,
                     corrected: str) -> DataFrame:
    """P32. One row per copied record with its published and its corrected label."""
    return df.filter(F.col(copy)).select(row_id, *keep, F.col(label).alias("label_published"),
                                         F.lit(corrected).alias("label_corrected"))


def assert_all(df: DataFrame, **conditions: Column) -> None:
    """P32. Raise unless every condition holds on every row; one aggregate."""
    r = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in conditions.items()]).first()
    bad = {k: r[k] for k in conditions if r[k]}
    if bad:
        raise AssertionError(f"rows breaking an invariant: {bad}")


# -------------------------------------------------------------- groupings
def contingency(df: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def _marginals(ct: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    k = list(keys)
    return (ct.groupBy(*k, "a").agg(F.sum("n").alias("na")), ct.groupBy(*k, "b").agg(F.sum("n").alias("nb")))


def association(ct: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A28, A29, A30. NMI (arithmetic mean), Cramér's V and weighted purity of b within a.

    Everything comes from the contingency table; χ² = n (Σ O² / (row·col) − 1) needs no zero
    cells. With H in counts, MI = Σ n_ab ln n_ab − Σ n_a ln n_a − Σ n_b ln n_b + n ln n, over n.

    The table of cells is stored, so that its rows are counted once and not for every marginal.
    """
    k, ct = list(keys), O.cached(ct)
    ma, mb = _marginals(ct, k)
    xlx = lambda c: F.sum(F.col(c) * F.log(c))                            # noqa: E731
    j = ct.join(ma, [*k, "a"]).join(mb, [*k, "b"])
    g = j.groupBy(*k).agg(F.sum("n").alias("N"), xlx("n").alias("sab"),
                          F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("phi"))
    pur = ct.groupBy(*k, "a").agg(F.max("n").alias("m")).groupBy(*k).agg(F.sum("m").alias("modal"))
    ga = ma.groupBy(*k).agg(xlx("na").alias("sa"), F.count(F.lit(1)).alias("ra"))
    gb = mb.groupBy(*k).agg(xlx("nb").alias("sb"), F.count(F.lit(1)).alias("rb"))
    if k:
        r = g.join(ga, k).join(gb, k).join(pur, k)
    else:
        one = lambda d: d.withColumn("_one", F.lit(1))                    # noqa: E731
        r = one(g).join(one(ga), "_one").join(one(gb), "_one").join(one(pur), "_one").drop("_one")
    N, lnN = F.col("N"), F.log("N")
    mi = (F.col("sab") - F.col("sa") - F.col("sb")) / N + lnN
    ha, hb = lnN - F.col("sa") / N, lnN - F.col("sb") / N
    v = F.sqrt(S.ratio(F.greatest(F.col("phi") - 1.0, F.lit(0.0)), F.least("ra", "rb") - 1))
    return r.select(*k, F.when((ha + hb) > 0, S.ratio(mi, (ha + hb) / 2)).otherwise(1.0).alias("nmi"),
                    F.when(F.least("ra", "rb") >= 2, v).alias("cramers_v"),
                    (F.col("modal") / N).alias("purity"))


#: Rows times replicates that are shuffled at a time.
REPLICATE_ROWS = 1 << 24


def permutation_null(df: DataFrame, grp: str, y: str, row_id: str, reps: int = 20) -> DataFrame:
    """I14. NMI of groups and labels; its mean, 95th percentile and excess when labels are shuffled; and of random groups of the same sizes.

    Replicates are shuffled a few at a time, one where the table is large. Only their cells are kept, in the shared
    folder, and what was shuffled is dropped before the next, so the disk holds one turn whatever `reps`.
    """
    df = df.select(row_id, y, F.col(grp).cast("string").alias(grp))
    most = max(1, REPLICATE_ROWS // max(1, df.count()))
    parts = []
    for i in range(0, reps, most):
        s = D.shuffle_labels(df, y, row_id, list(range(i, min(reps, i + most))), [grp])
        parts.append(shuffles_dropped(contingency(s, grp, f"{y}_shuffled", ["rep"])))
    fake = D.size_matched_grouping(df, grp, row_id).withColumn("fake_grp", F.col("fake_grp").cast("string"))
    parts += [contingency(t.withColumn("rep", F.lit(r)), g, y, ["rep"]) for t, g, r in ((df, grp, -1), (fake, "fake_grp", -2))]
    a = association(reduce(DataFrame.unionByName, parts), ["rep"])
    own, null = F.max(F.when(F.col("rep") == -1, F.col("nmi"))), F.when(F.col("rep") >= 0, F.col("nmi"))
    return a.agg(own.alias("nmi"), F.avg(null).alias("nmi_null_mean"), F.percentile(null, F.lit(0.95)).alias("nmi_null_p95"),
                 (own - F.avg(null)).alias("nmi_excess_over_null"), F.max(F.when(F.col("rep") == -2, F.col("nmi"))).alias("nmi_sizematched_null"),
                 F.count_if(F.col("rep") >= 0).alias("reps"))


def concentration(df: DataFrame, grp: str, keys: list[str] = ()) -> DataFrame:
    """A31. Groups, largest share, top-5 share and Gini of the group sizes.

    Gini needs ranks of the sizes only; equal sizes are taken together, so the ordered pass
    reads one row per distinct size.
    """
    k = list(keys)
    sizes = df.groupBy(*k, grp).agg(F.count(F.lit(1)).alias("s"))
    hist = sizes.groupBy(*k, "s").agg(F.count(F.lit(1)).alias("m"))
    up = Window.partitionBy(*(k or [F.lit(0)])).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*(k or [F.lit(0)])).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    allw = Window.partitionBy(*(k or [F.lit(0)]))
    h = hist.select("*", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("lo"),
                    F.coalesce(F.sum("m").over(down), F.lit(0)).alias("above"), F.sum("m").over(allw).alias("g"),
                    F.sum(F.col("m") * F.col("s")).over(allw).alias("N"))
    m, lo, g = F.col("m"), F.col("lo"), F.col("g")
    # sum of (2i - g - 1) over the m ranks lo+1 .. lo+m
    weight = m * (2 * lo + m + 1) - m * (g + 1)
    top5 = F.least(m, F.greatest(F.lit(5) - F.col("above"), F.lit(0)))
    r = h.groupBy(*k).agg(F.max("g").alias("n_groups"), (F.max("s") / F.max("N")).alias("largest_group_share"),
                          (F.sum(top5 * F.col("s")) / F.max("N")).alias("top5_share"),
                          F.when(F.max("g") > 1, F.sum(weight * F.col("s")) / F.max("N") / F.max("g"))
                          .otherwise(0.0).alias("gini"))
    return r


def attacker_coverage(df: DataFrame, grp: str, y: str = "y") -> DataFrame:
    """A42. Groups in all, attack-only, mixed and benign-only, and the largest share."""
    g = df.groupBy(grp).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("n1"))
    n, n1 = F.col("n"), F.col("n1")
    return g.agg(F.count(F.lit(1)).alias("addresses"), F.count_if(n1 == n).alias("attack_only"),
                 F.count_if((n1 > 0) & (n1 < n)).alias("mixed"), F.count_if(n1 == 0).alias("benign_only"),
                 (F.max("n") / F.sum("n")).alias("largest_share"))


def attackers_per_category(df: DataFrame, grp: str, category: str, share: float = 0.9) -> DataFrame:
    """A42. Per attack category: addresses, top-1 and top-3 share, addresses for 90 %.

    Works on the histogram of address sizes: the ordered pass reads distinct sizes.
    """
    c = df.groupBy(category, grp).agg(F.count(F.lit(1)).alias("s"))
    h = c.groupBy(category, "s").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy(category).orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    allw = Window.partitionBy(category)
    h = h.select("*", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("above"),
                 F.coalesce(F.sum(F.col("m") * F.col("s")).over(before), F.lit(0)).alias("cum"),
                 F.sum(F.col("m") * F.col("s")).over(allw).alias("N"))
    s, m = F.col("s"), F.col("m")
    take = lambda n: F.sum(F.least(m, F.greatest(F.lit(n) - F.col("above"), F.lit(0))) * s) / F.max("N")
    # first address at which the cumulative share reaches the level
    need = F.ceil((F.lit(share) * F.col("N") - F.col("cum")) / s)
    hit = F.when(F.col("cum") + m * s >= F.lit(share) * F.col("N"), F.col("above") + F.greatest(need, F.lit(1)))
    return h.groupBy(category).agg(F.max("N").alias("flows"), F.sum("m").alias("attacker_addresses"),
                                   take(1).alias("top1_share"), take(3).alias("top3_share"),
                                   F.min(hit).alias("addresses_for_90pct"))


def split_coverage(rows: DataFrame, split: str, category: str, grp: str) -> DataFrame:
    """A43. Rows and groups of every category on each side of every split; train share.

    `rows` carries `side`. Absent sides count 0, so a missing category shows.
    """
    g = rows.groupBy(split, category).agg(
        F.count_if(F.col("side") == "train").alias("train_flows"), F.count_if(F.col("side") == "test").alias("test_flows"),
        F.count_distinct(F.when(F.col("side") == "train", F.col(grp))).alias("train_groups"),
        F.count_distinct(F.when(F.col("side") == "test", F.col(grp))).alias("test_groups"))
    n = F.col("train_flows") + F.col("test_flows")
    return g.withColumn("train_share", S.ratio0("train_flows", n)) \
        .withColumn("missing", ((F.col("train_flows") == 0) | (F.col("test_flows") == 0)).cast("int"))


def nn_chance(df: DataFrame, session: str, category: str) -> DataFrame:
    """A44. Chance that a random neighbour shares the session, overall and within the category."""
    n = df.groupBy(session, category).agg(F.count(F.lit(1)).alias("ns"))
    n = n.groupBy(session).agg(F.sum("ns").alias("ns"), F.min(category).alias("cat"))
    nc = df.groupBy(F.col(category).alias("cat")).agg(F.count(F.lit(1)).alias("nc"))
    N = df.agg(F.count(F.lit(1))).scalar()
    j = n.join(nc, "cat").withColumn("_p", F.col("ns") / N)
    return j.agg(F.count(F.lit(1)).alias("sessions"), F.sum("ns").alias("windows"),
                 F.sum(F.col("_p") * F.col("_p")).alias("chance_any"),
                 F.sum(F.col("_p") * F.col("ns") / F.col("nc")).alias("chance_same_category"))
