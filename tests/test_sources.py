import zipfile

import pytest
from pyspark.sql import functions as F

from flowaudit.sources import readers as RD
from flowaudit.sources import sinks as SK


def test_json_lines_counts_malformed(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text('{"timestamp": 2000.0, "ue_id": 2, "dlBytes": 5}\n\nnot json\n{"ue_id": 1}\n{"timestamp": 1000.0, "ue_id": 1, "dlBytes": 7}\n')
    rows, bad = RD.scan_json_lines(spark, str(p))
    assert [(r.ts, r.dlBytes) for r in rows.collect()] == [(1.0, 7), (2.0, 5)] and bad.first().malformed == 2


def test_zeek_log(spark, tmp_path):
    p = tmp_path / "conn.log"
    p.write_text("#separator \\x09\n#fields\tts\tid.orig_h\tid.resp_h\tproto\tduration\torig_pkts\tresp_pkts\torig_ip_bytes\tresp_ip_bytes\n"
                 "1\t10.0.0.1\t10.0.0.2\ttcp\t0.5\t3\t2\t300\t200\n2\t10.0.0.1\t10.0.0.3\tudp\t-\t1\t0\t28\t0\n#close\n")
    d = RD.scan_zeek_log(spark, str(p)).orderBy("ts").collect()
    assert len(d) == 2 and d[0]["duration"] == 0.5 and d[1]["duration"] is None and d[0]["id.orig_h"] == "10.0.0.1"
    from flowaudit.operators import space as SP
    assert SP.shared_from_zeek_log(RD.scan_zeek_log(spark, str(p))).count() == 2


def test_csv_schema_and_nan(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("a,b\n1,NaN\n2,3.5\n")
    d = RD.scan_flows_csv(spark, str(p), "a BIGINT, b DOUBLE", ["b"])
    assert sorted(str(r.b) for r in d.collect()) == ["3.5", "None"] and d.columns == ["b"]


def test_zipped_csv(spark, tmp_path):
    paths = []
    for i in range(3):
        z = tmp_path / f"z{i}.zip"
        with zipfile.ZipFile(z, "w") as f:
            f.writestr("x.csv", "k,v,w\n" + "\n".join(f"{j},{i},q" for j in range(5)))
        paths.append(str(z))
    d = RD.scan_zipped_csv(spark, paths, "x.csv", "k INT, v DOUBLE", chunk_rows=2)
    assert d.count() == 15 and d.agg(F.sum("v")).first()[0] == 15


def test_many_files_with_kinds(spark, tmp_path):
    for n in ("004-syn-flood.csv", "003a-pfcp.csv"):
        (tmp_path / n).write_text("protocol,label\n6,malicious\n17,background\n")
    d = RD.scan_many(spark, [str(tmp_path / "004-syn-flood.csv"), str(tmp_path / "003a-pfcp.csv")], "protocol INT, label STRING")
    assert sorted(r.category for r in d.collect()) == ["background", "background", "pfcp_deletion", "syn_flood"]


def test_shards_keep_the_first(spark, tmp_path):
    for i in (0, 1):
        spark.createDataFrame([(1, i), (2 + i, i)], "k int, v int").write.parquet(str(tmp_path / f"s{i}"))
    d = RD.scan_shards(spark, [str(tmp_path / "s0"), str(tmp_path / "s1")], ["k"])
    assert sorted((r.k, r.v) for r in d.collect()) == [(1, 0), (2, 0), (3, 1)]


def test_resume_guard_and_log(spark, tmp_path):
    p = str(tmp_path / "out")
    a = spark.createDataFrame([(1, 101), (2, 102)], "k int, split_seed int")
    assert SK.append_resume(a, p, ["k"]) == 2
    assert SK.append_resume(a.unionByName(spark.createDataFrame([(3, 103)], "k int, split_seed int")), p, ["k"]) == 1
    SK.guard_no_clobber(spark, p, 3)
    with pytest.raises(FileExistsError):
        SK.guard_no_clobber(spark, p, 2)
    SK.guard_no_clobber(spark, str(tmp_path / "none"), 1)
    for w in ("one", "two"):
        SK.log_access(spark, str(tmp_path / "log"), w)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_score_store_prunes(spark, tmp_path):
    p = str(tmp_path / "scores")
    d = spark.range(40).select(F.col("id").alias("row_id"), F.when(F.col("id") < 20, "a").otherwise("b").alias("domain"), (F.col("id") % 2).alias("split_seed"), F.lit(0.5).alias("score"))
    SK.write_scores(d, p)
    plan = spark.read.parquet(p).filter("domain = 'a' and split_seed = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(domain" in plan and spark.read.parquet(p).filter("domain = 'a' and split_seed = 1").count() == 10


def test_checksums_and_formats(spark, tmp_path):
    import hashlib
    f = tmp_path / "x.bin"
    f.write_bytes(b"abc")
    got = {r.path: r for r in SK.checksum_files(spark, [str(f), str(tmp_path / "gone")]).collect()}
    assert got[str(f)].sha256 == hashlib.sha256(b"abc").hexdigest() and got[str(f)].bytes == 3 and got[str(tmp_path / "gone")].status == "MISSING"
    g = tmp_path / "y.gz"
    g.write_bytes(b"not unpacked" * 1000)
    r = SK.checksum_files(spark, [g.as_uri()], chunk=7).first()
    assert r.bytes == 12000 and r.sha256 == hashlib.sha256(b"not unpacked" * 1000).hexdigest() and r.status == "present"
    d = spark.createDataFrame([(1, "a")], "k int, v string")
    for fmt, comp in (("csv", "gzip"), ("json", None), ("parquet", "snappy")):
        SK.write_table(d, str(tmp_path / fmt), fmt, compression=comp)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().v == "a"
    assert '"n_rows":1' in SK.provenance(d, {"seed": 7}).first().provenance


def test_specs(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"map": {"DoS": "dos"}}')
    spec = RD.load_spec(str(tmp_path / "m.json"))
    assert RD.label_map(spark, spec["map"]).first().canonical == "dos"


def test_telemetry_projection_reaches_the_scan(spark, tmp_path):
    spark.range(3).select("id", F.lit(1).alias("a"), F.lit(2).alias("b")).write.parquet(str(tmp_path / "t"))
    d = RD.scan_telemetry_table(spark, str(tmp_path / "t"), ["a"])
    assert "ReadSchema: struct<a:int>" in d._jdf.queryExecution().toString()
