import math

import pytest
from pyspark.sql import functions as F

from flowaudit.operators import space as SP

ZEEK = "duration double, src_bytes double, src_ip_bytes double, dst_ip_bytes double, src_pkts double, dst_pkts double, proto string"
ARGUS = "Dur double, SrcBytes double, DstBytes double, SrcPkts double, DstPkts double, TotPkts double, TotBytes double, Proto string"


def zeek(spark, *rows):
    return SP.shared_from_zeek(spark.createDataFrame(rows, ZEEK))


def test_equal_traffic_equal_vectors(spark):
    z = zeek(spark, (1.0, 0.0, 1000.0, 500.0, 10.0, 5.0, "tcp")).first()
    a = SP.shared_from_argus(spark.createDataFrame([(1.0, 1140.0, 570.0, 10.0, 5.0, 15.0, 1710.0, "tcp")], ARGUS)).first()
    assert tuple(z) == tuple(a)
    raw = SP.shared_from_argus(spark.createDataFrame([(1.0, 1140.0, 570.0, 10.0, 5.0, 15.0, 1710.0, "tcp")], ARGUS), link_bytes=0).first()
    assert raw.src_bytes == pytest.approx(math.log1p(1140)) and raw.tot_bytes == pytest.approx(math.log1p(1710))


@pytest.mark.parametrize("payload", [0.0, 999999.0])
def test_payload_bytes_are_never_used(spark, payload):
    assert zeek(spark, (1.0, payload, 1000.0, 0.0, 1.0, 0.0, "tcp")).first().src_bytes == pytest.approx(math.log1p(1000))


@pytest.mark.parametrize("proto, ip, link", [("tcp", 40, 54), ("udp", 28, 42), ("icmp", 28, 42)])
def test_minimum_packets(spark, proto, ip, link):
    z = zeek(spark, (0.0, 0.0, float(ip), 0.0, 1.0, 0.0, proto)).first()
    a = SP.shared_from_argus(spark.createDataFrame([(0.0, float(link), 0.0, 1.0, 0.0, 1.0, float(link), proto)], ARGUS)).first()
    assert tuple(z) == tuple(a)


def test_protocols(spark):
    r = zeek(spark, (1.0, 0.0, 1.0, 1.0, 1.0, 1.0, "sctp"), (1.0, 0.0, 1.0, 1.0, 1.0, 1.0, " TCP")).collect()
    assert r[0].proto_other == 1 and r[1].proto_tcp == 1 and r[1].proto_other == 0


def test_degenerate_rows_are_finite(spark):
    r = zeek(spark, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, "tcp"), (None, None, None, None, None, None, None), (float("nan"), 0.0, 1.0, 1.0, 0.0, 1.0, "udp"))
    for row in r.collect():
        assert all(v is not None and math.isfinite(v) for v in row)


def test_tunnel_overhead(spark):
    nf = spark.createDataFrame([(1000, 98, 0, 1, 0, 6, 7), (1000, 54, 0, 1, 0, 6, 0)],
                               "bidirectional_duration_ms long, src2dst_bytes long, dst2src_bytes long, src2dst_packets long, dst2src_packets long, protocol long, tunnel_id long")
    a, b = SP.shared_from_nfstream(nf).collect()
    assert tuple(a) == tuple(b) and a.src_bytes == pytest.approx(math.log1p(40)) and a.proto_tcp == 1


def test_schema_errors(spark):
    with pytest.raises(KeyError, match="src_ip_bytes"):
        SP.shared_from_zeek(spark.createDataFrame([(1.0,)], "duration double"))
    z = zeek(spark, (1.0, 0.0, 1.0, 1.0, 1.0, 1.0, "tcp"))
    with pytest.raises(ValueError):
        SP.assert_compatible(z, z.select(*reversed(z.columns)))
    assert z.columns == SP.SHARED_COLUMNS and len(z.columns) == 18
    assert SP.select_features(z, "robust").columns == SP.ROBUST_COLUMNS


def test_strict_labels(spark):
    d = spark.createDataFrame([("a",), ("new",)], "c string")
    with pytest.raises(ValueError, match="new"):
        SP.map_labels(d, "c", {"a": 1}, "y")
    with pytest.raises(Exception, match="unmapped label new"):
        SP.map_labels(d, "c", {"a": 1}, "y", check=False).collect()
    assert SP.map_labels(d.filter("c = 'a'"), "c", {"a": 1}, "y").first().y == 1


def test_duplicates_subset_keeps_the_first(spark):
    d = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "id int, c string")
    assert sorted(r.id for r in SP.drop_duplicates_subset(d, ["c"], "id").collect()) == [1, 2]


def test_feature_sets(spark):
    d = spark.range(1).select(*[F.lit(1).alias(c) for c in ("uid", "src_port", "history", "duration", "traffic_type")])
    assert SP.drop_identity(d, "full").columns == ["src_port", "duration"]
    assert SP.drop_identity(d, "transferable").columns == ["duration"]
    with pytest.raises(ValueError):
        SP.drop_identity(d, "other")


def test_round_half_even(spark):
    d = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r.x for r in SP.round_floats(d, 0).collect()] == [0.0, 2.0, 2.0]
