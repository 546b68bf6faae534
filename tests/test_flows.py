import struct

import pytest
from captures import (ACK, FINACK, PSHACK, SYN, SYNACK, ethernet, ipv6, sll, sll2, tcp, udp, write_pcap, write_pcapng)
from pyspark.sql import functions as F

from flowaudit.operators import flows as FL
from flowaudit.sources import captures as CP


def packets_of(spark, path):
    return CP.parsed(CP.decode_headers(CP.scan_packets(spark, str(path))))


def udp_at(times):
    return [(t, ethernet(udp("10.0.0.1", "10.0.0.2", 5000, 53, b"x" * 4))) for t in times]


def flows_of(spark, path, **kw):
    return FL.flow_features(packets_of(spark, path), **kw)


CLIENT, SERVER = ("192.0.2.44", 40022), ("198.51.100.7", 8883)


def test_handshake(spark, tmp_path):
    """A short session: opened, a publish and two answers, closed by the server."""
    def sent(a, b, flags, load=b""):
        return ethernet(tcp(a[0], b[0], a[1], b[1], flags, load))
    steps = [(77.00, CLIENT, SERVER, SYN, b""), (77.25, SERVER, CLIENT, SYNACK, b""), (77.50, CLIENT, SERVER, ACK, b""), (78.00, CLIENT, SERVER, PSHACK, b"m" * 120),
             (78.25, SERVER, CLIENT, PSHACK, b"r" * 30), (78.75, SERVER, CLIENT, PSHACK, b"r" * 7), (79.00, SERVER, CLIENT, FINACK, b"")]
    f = flows_of(spark, write_pcap(tmp_path / "h.pcap", [(t, sent(a, b, fl, x)) for t, a, b, fl, x in steps])).collect()
    assert len(f) == 1
    r = f[0]
    assert (r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.proto) == (*CLIENT, *SERVER, 6)
    assert (r.fwd_pkts, r.bwd_pkts, r.fwd_bytes, r.bwd_bytes) == (3, 4, 120, 37)
    assert (r.handshake_complete, r.flag_syn, r.flag_ack, r.flag_fin, r.flag_psh) == (1, 2, 6, 1, 3)
    assert r.duration == pytest.approx(2.0, abs=1e-6) and r.total_ip_bytes == 7 * 40 + 157
    assert r.iat_mean == pytest.approx(2 / 6, abs=1e-6) and r.iat_min == pytest.approx(0.25, abs=1e-6)
    assert list(f[0].asDict())[1:] == FL.FLOW_COLUMNS


@pytest.mark.parametrize("times, n", [([1000, 1005, 1100], 2), ([1000, 1020], 1), ([1000, 1030], 1), ([0, 1, 200], 2)])
def test_idle_timeout(spark, tmp_path, times, n):
    assert flows_of(spark, write_pcap(tmp_path / "u.pcap", udp_at(times))).count() == n


def test_active_timeout_and_exact_boundary(spark, tmp_path):
    p = write_pcap(tmp_path / "a.pcap", udp_at([10.0 * i for i in range(41)]))
    got = [(r.total_pkts, r.duration) for r in flows_of(spark, p).orderBy("first_ts").collect()]
    assert [g[0] for g in got] == [13, 13, 13, 2]          # 120 s exactly does not split
    assert all(g[1] <= 120 for g in got)


def test_very_long_episode_uses_pointer_doubling(spark, tmp_path):
    p = write_pcap(tmp_path / "l.pcap", udp_at([7.3 * i + (i % 3) for i in range(200)]))
    a = [tuple(r) for r in flows_of(spark, p).orderBy("first_ts").collect()]
    b = [tuple(r) for r in flows_of(spark, p, long_rows=0).orderBy("first_ts").collect()]
    assert a == b and len(a) > 8


def test_single_packet_rates_are_zero(spark, tmp_path):
    r = flows_of(spark, write_pcap(tmp_path / "s.pcap", [(5.0, ethernet(tcp("1.1.1.1", "2.2.2.2", 1, 2, SYN)))])).first()
    assert (r.pkts_per_s, r.bytes_per_s, r.total_ip_bytes, r.iat_std) == (0.0, 0.0, 40, 0.0)


def test_interleaved_flows(spark, tmp_path):
    ps = [(1 + i * 0.01 + k * 1e-4, ethernet(udp(f"10.0.1.{k}", "10.0.0.9", 4000 + k, 53))) for i in range(40) for k in range(25)]
    f = flows_of(spark, write_pcap(tmp_path / "i.pcap", ps))
    assert f.count() == 25 and f.agg(F.sum("total_pkts")).first()[0] == 1000


def test_both_directions_one_flow(spark, tmp_path):
    ps = [(1.0, ethernet(udp("10.0.0.1", "10.0.0.2", 9, 53))), (1.1, ethernet(udp("10.0.0.2", "10.0.0.1", 53, 9, b"y" * 100))),
          (1.2, ethernet(udp("10.0.0.1", "10.0.0.2", 9, 53, b"z" * 50)))]
    p = packets_of(spark, write_pcap(tmp_path / "b.pcap", ps))
    r = FL.flow_features(p).first()
    assert (r.fwd_pkts, r.bwd_pkts, r.fwd_bytes, r.bwd_bytes) == (2, 1, 50, 100)
    v = FL.flow_volumes(FL.assign_flows(FL.flow_key(p), ["file", "k"]), ["file", "k", "episode", "seg"]).first()
    assert (v.total_pkts, v.fwd_pkts, v.total_ip_bytes) == (r.total_pkts, 2, r.total_ip_bytes)


@pytest.mark.parametrize("link, wrap", [(1, ethernet), (113, sll), (276, sll2), (101, lambda x: x), (228, lambda x: x), (0, lambda x: b"\2\0\0\0" + x)])
def test_link_types(spark, tmp_path, link, wrap):
    p = write_pcap(tmp_path / "x.pcap", [(1.0, wrap(udp("10.2.2.1", "10.2.2.2", 7, 8, b"abc")))], link)
    r = packets_of(spark, p).first()
    assert (r.src, r.dst, r.sport, r.dport, r.payload_len, r.ttl) == ("10.2.2.1", "10.2.2.2", 7, 8, 3, 64)


def test_unknown_link_type_raises(spark, tmp_path):
    p = write_pcap(tmp_path / "bad.pcap", [(1.0, b"\0" * 40)], link=147)
    with pytest.raises(Exception, match="unsupported datalink"):
        CP.scan_packets(spark, str(p)).collect()


def test_formats_read_alike(spark, tmp_path):
    import gzip
    ps = [(1.25 + i, ethernet(udp("10.0.0.1", "10.0.0.2", 1, 2, b"q" * i))) for i in range(5)]
    write_pcap(tmp_path / "a.pcap", ps)
    write_pcap(tmp_path / "b.pcap", ps, end=">")
    write_pcap(tmp_path / "c.pcap", ps, nano=True)
    write_pcapng(tmp_path / "d.pcapng", ps)
    (tmp_path / "e.pcap.gz").write_bytes(gzip.compress((tmp_path / "a.pcap").read_bytes()))
    d = packets_of(spark, tmp_path)
    per = d.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "ts", "payload_len", "src"))).alias("p")).collect()
    assert len(per) == 5 and len({str(r.p) for r in per}) == 1


def test_accounting_and_ipv6(spark, tmp_path):
    frames = [ethernet(udp("1.1.1.1", "2.2.2.2", 1, 2)), ethernet(b"\0" * 28, 0x0806), b"\1\2\3", ethernet(b"\x45\0\0\x28"),
              ethernet(ipv6("2001:db8::1", "2001:db8::2", 17, udp("1.1.1.1", "2.2.2.2", 5, 6, b"zz")[20:]), 0x86DD)]
    d = CP.decode_headers(CP.scan_packets(spark, str(write_pcap(tmp_path / "m.pcap", [(float(i), f) for i, f in enumerate(frames)]))))
    c = CP.coverage(d).first()
    assert c.records == 5 and c.parsed + c.skipped_link + c.skipped_not_ip + c.skipped_truncated == 5
    assert (c.parsed, c.skipped_link, c.skipped_not_ip, c.skipped_truncated) == (2, 1, 1, 1)
    six = CP.parsed(d).filter("src like '%:%'").first()
    assert (six.src, six.dst, six.sport, six.dport, six.payload_len, six.ip_len) == ("2001:db8::1", "2001:db8::2", 5, 6, 2, 50)


def test_empty_capture(spark, tmp_path):
    assert flows_of(spark, write_pcap(tmp_path / "e.pcap", [])).count() == 0


def test_mac_addresses(spark, tmp_path):
    p = write_pcap(tmp_path / "h.pcap", udp_at([1, 2]))
    m = FL.mac_pairs(CP.mac_columns(CP.scan_packets(spark, str(p)))).first()
    assert (m.eth_src, m.eth_dst, m.packets) == ("22:22:22:22:22:22", "11:11:11:11:11:11", 2)


def test_partition_invariance(spark, tmp_path):
    ps = [(float(i * 11 % 97) + i / 7, ethernet(udp(f"10.0.0.{i % 5}", "10.9.9.9", 1000 + i % 3, 53, b"a" * (i % 9)))) for i in range(300)]
    ps.sort()
    p = packets_of(spark, write_pcap(tmp_path / "p.pcap", ps)).persist()
    res = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        res.append(sorted(map(str, FL.flow_features(p).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert res[0] == res[1]


def test_fingerprint_changes_with_semantics():
    assert FL.fingerprint() == FL.fingerprint()
    assert len({FL.fingerprint(), FL.fingerprint(idle_s=31.0), FL.fingerprint(bidirectional=False), FL.fingerprint(min_packets=2)}) == 4


def test_one_way_keys_and_direction_policy(spark, tmp_path):
    ps = [(1.0, ethernet(udp("10.0.0.1", "10.0.0.2", 9, 53))), (1.1, ethernet(udp("10.0.0.2", "10.0.0.1", 53, 9, b"y" * 100))), (1.2, ethernet(udp("10.0.0.1", "10.0.0.2", 9, 53, b"z" * 50)))]
    f = flows_of(spark, write_pcap(tmp_path / "w.pcap", ps), bidirectional=False)
    assert sorted((r.src_port, r.fwd_pkts, r.bwd_pkts, r.fwd_bytes) for r in f.collect()) == [(9, 2, 0, 50), (53, 1, 0, 100)]
    with pytest.raises(ValueError, match="direction"):
        flows_of(spark, tmp_path / "w.pcap", direction="larger_port")


def test_packet_blocks_without_loss(spark, tmp_path):
    """Simple, enhanced and old packet blocks are all records; a cut last record is one too."""
    frame = ethernet(udp("10.0.0.1", "10.0.0.2", 9, 53, b"abcd"))
    pad = frame + b"\0" * (-len(frame) % 4)

    def block(kind, body):
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    raw = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    raw += block(3, struct.pack("<I", len(frame)) + pad) * 2
    raw += block(6, struct.pack("<IIIII", 0, 0, 5_000_000, len(frame), len(frame)) + pad)
    raw += block(2, struct.pack("<HHIIII", 0, 7, 0, 6_000_000, len(frame), len(frame)) + pad)
    (tmp_path / "blocks.pcapng").write_bytes(raw)
    whole = write_pcap(tmp_path / "cut.pcap", [(1.0, frame), (2.0, frame)]).read_bytes()
    (tmp_path / "cut.pcap").write_bytes(whole[:-len(frame) + 20])
    c = {r.file: r for r in CP.coverage(CP.decode_headers(CP.scan_packets(spark, str(tmp_path)))).collect()}
    assert (c["blocks.pcapng"].records, c["blocks.pcapng"].parsed, c["blocks.pcapng"].skipped_untimed) == (4, 2, 2)
    assert (c["cut.pcap"].records, c["cut.pcap"].parsed, c["cut.pcap"].skipped_truncated) == (2, 1, 1)
    times = [r.ts for r in packets_of(spark, tmp_path / "blocks.pcapng").orderBy("seq").collect()]
    assert times == [5.0, 6.0]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.pcapng").write_bytes(raw[:28] + block(6, b"\0" * 20))
    with pytest.raises(Exception, match="unreadable packet block"):
        CP.scan_packets(spark, str(tmp_path / "bad")).collect()


def test_long_header_chains_and_equal_names(spark, tmp_path):
    chain = b"".join(struct.pack("!BB6x", 60 if k < 8 else 17, 0) for k in range(9))
    frame = ethernet(ipv6("2001:db8::1", "2001:db8::2", 60, chain + udp("1.1.1.1", "2.2.2.2", 5, 6, b"zz")[20:]), 0x86DD)
    for d in "ab":
        (tmp_path / d).mkdir()
        write_pcap(tmp_path / d / "x.pcap", [(1.0, frame)])
    p = packets_of(spark, tmp_path)
    assert sorted((r.file, r.sport, r.dport, r.payload_len) for r in p.collect()) == [("a/x.pcap", 5, 6, 2), ("b/x.pcap", 5, 6, 2)]
    assert FL.flow_features(p).count() == 2


def test_a_flood_is_many_tasks_and_its_gaps_are_right(spark):
    from pyspark.sql import Window
    flood = [(k * 0.0025, k, "a", "b", 1, 2) if k % 3 else (k * 0.0025, k, "b", "a", 2, 1) for k in range(40000)]
    other = [(k % 400 * 0.25, 50000 + k, f"c{k // 400}", "b", 5, 2) for k in range(40000)]
    d = spark.createDataFrame(flood + other, "ts double, seq long, src string, dst string, sport int, dport int").withColumn("proto", F.lit(17))
    fk = ["k", "episode", "seg"]
    flows = FL.assign_flows(FL.flow_key(d), ["k"], slice_rows=500).persist()
    assert flows.count() == 80000
    tasks = sorted(r["count"] for r in flows.repartition(16, *fk, "slice").groupBy(F.spark_partition_id()).count().collect())
    assert tasks[-1] <= 5 * tasks[len(tasks) // 2] and flows.groupBy(*fk, "slice").count().agg(F.max("count")).first()[0] <= 1000
    w = Window.partitionBy(*fk).orderBy("ts", "seq")
    fwd = (F.col("src") == F.first("src").over(w)) & (F.col("sport") == F.first("sport").over(w))
    want = flows.withColumn("want_fwd", fwd).withColumn("want", F.col("ts") - F.lag("ts").over(w))
    same = F.last(F.when(F.col("want_fwd"), F.col("ts")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    want = want.withColumn("want_own", F.when(F.col("want_fwd"), F.col("ts") - same)).select("seq", "want_fwd", "want", "want_own")
    got = FL.inter_arrival(flows, fk).join(want, "seq")
    assert got.count() == 80000
    assert got.filter(~(F.col("fwd").eqNullSafe(F.col("want_fwd")) & F.col("iat").eqNullSafe(F.col("want")) & F.col("iat_fwd").eqNullSafe(F.col("want_own")))).count() == 0
    flows.unpersist()


@pytest.mark.parametrize("write, ends", [(write_pcap, ("<", ">")), (write_pcapng, ("<",))])
def test_splits_of_a_capture_hold_the_same_packets(spark, tmp_path, write, ends):
    """Cuts anywhere: inside headers, inside frames that hold captures, through runs of zeros and of line feeds."""
    import random
    rng = random.Random(4)
    inner = struct.pack("<IIII", 1, 2, 60, 60) + b"\0" * 60
    kinds = [lambda: rng.randbytes(rng.randrange(0, 900)), lambda: b"\0" * rng.randrange(0, 700), lambda: b"\n" * rng.randrange(0, 300), lambda: inner * rng.randrange(1, 9)]
    ps = [(round(1 + i * 0.001, 6), ethernet(udp("10.0.0.1", "10.0.0.2", 1, 2, rng.choice(kinds)()))) for i in range(900)]
    ps += [(9.0, b"\n" * 40), (10.0, b"x" * 59 + b"\n")]
    for k, e in enumerate(ends):
        write(tmp_path / f"f{k} +ü.{'pcap' if write is write_pcap else 'pcapng'}", ps, **({"end": e} if write is write_pcap else {}))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("10m", "4001b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            d = CP.scan_packets(spark, str(tmp_path))
            got = {}
            for r in d.orderBy("file", "seq").collect():
                got.setdefault(r.file, []).append((r.seq, r.ts, bytes(r.frame)))
            assert sorted(got) == sorted(f.name for f in tmp_path.iterdir())
            for v in got.values():
                assert v == [(i, pytest.approx(t), f) for i, (t, f) in enumerate(ps)]
            assert size == "10m" or d.select(F.spark_partition_id()).distinct().count() > 20
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_a_split_that_begins_in_a_captured_capture_is_walked_again(spark, tmp_path):
    inner = struct.pack("<IIII", 1, 2, 60, 60) + b"\0" * 60
    ps = [(float(i), ethernet(udp("10.0.0.1", "10.0.0.2", 1, 2, inner * 15))) for i in range(2500)]
    write_pcap(tmp_path / "n.pcap", ps)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1200000b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1200000b")
        d = CP.scan_packets(spark, str(tmp_path / "n.pcap"))
        assert d.rdd.getNumPartitions() > 2
        assert [(r.seq, r.ts, r.frame_len) for r in d.select("seq", "ts", "frame_len").orderBy("seq").collect()] == [(i, t, len(f)) for i, (t, f) in enumerate(ps)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304b")


def test_no_captures_raises(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        CP.scan_packets(spark, str(tmp_path))
