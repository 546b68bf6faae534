"""Conflicts of one record, and of one pair of hosts, that are in very many files."""
from collections import Counter

from pyspark.sql import functions as F

from flowaudit.operators import audit as A


def test_a_record_in_all_files_is_many_tasks(spark):
    n = 400
    d = spark.range(n).select(F.col("id").cast("int").alias("file"), F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(k).alias("k")) for y in (0, 1) for k in range(2)])).alias("e"))
    d = d.filter(~((F.col("file") % 3 == 0) & (F.col("e.y") == 1) & (F.col("e.k") == 1))).select("file", "e.y", F.lit(None).cast("double").alias("a"), F.lit(1.0).alias("b"))
    few = spark.createDataFrame([(1, 0, 5.0, 2.0), (2, 1, 5.0, 2.0), (3, 1, 6.0, 2.0)], "file int, y int, a double, b double")
    p = A.pair_conflicts_between_files(d.unionByName(few), ["a", "b"], "file")
    got = {(r.f_b, r.f_a): (r.records, r.benign_flows, r.attack_flows, r.equal_counts, r.within_one) for r in p.collect()}
    assert len(got) == n * (n - 1)
    for b, a in ((0, 1), (1, 0), (5, 399), (399, 3)):
        attack = 1 if a % 3 == 0 else 2
        assert got[b, a] == (1, 2, attack, int(attack == 2), 1)
    assert got[1, 2] == (2, 3, 3, 2, 2) and A.FILES_TOGETHER * 6 < n


def test_attacks_of_the_same_hosts_in_other_files(spark):
    copies = [(f, "h", f * 10 + k) for f in range(60) for k in range(2)] + [(1, "alone", 5)]
    attacks = [(f, "h", f"t{f % 4}", f + 0.5) for f in range(0, 60, 2) for _ in range(3)] + [(7, "h", None, 0.25)]
    c, a = spark.createDataFrame(copies, "file int, host string, ts long"), spark.createDataFrame(attacks, "file int, host string, kind string, ts double")
    c = c.withColumn("ts", F.col("ts").cast("double")).withColumn("kind", F.lit("Benign"))
    got = {(r["file"], r.host): r for r in A.same_hosts_attacks(c, a, ["host"], "file", "kind", "ts").collect()}
    assert len(got) == 61 and got[1, "alone"].attack_flows == 0 and got[1, "alone"].attack_files == []
    for f in range(60):
        rest = [x for x in attacks if x[0] != f]
        r = got[f, "h"]
        assert (r.benign_copies, r.attack_flows, r.attack_files) == (2, len(rest), sorted({x[0] for x in rest}))
        assert r.attack_types == sorted({x[2] for x in rest} - {None}) and (r.attack_first, r.attack_last) == (min(x[3] for x in rest), max(x[3] for x in rest))
    assert Counter(type(r.attack_flows) for r in got.values()) == {int: 61}
