"""Remaining projections (P1, P2, P4, P14, P18), ids (G8), app-field overrides (R2/J5) and the
multi-capture key prefix."""

from pyspark.sql import functions as F

from netflow_spark.fixtures import packets
from netflow_spark.functions import classify as cl
from netflow_spark.functions.normalize import canonical_columns, fill_int_columns, normalize_packets
from netflow_spark.operators.disposition import tag_flows
from netflow_spark.operators.ids import dense_id, hash_id
from tests.conftest import SF_SMALL


def test_normalize_fill_canonical(spark):
    df = spark.createDataFrame([("12", "1.5", "1,234", "80", None), ("x", None, None, "0x50", "7")],
                               "frame_number string, timestamp string, source_port string, destination_port string, "
                               "tcp_stream_index string")
    r = normalize_packets(df).collect()
    assert (r[0].frame_number, r[0].timestamp, r[0].source_port, r[0].destination_port) == (12, 1.5, 1234, 80)
    assert (r[1].frame_number, r[1].timestamp, r[1].destination_port, r[1].tcp_stream_index) == (0, 0.0, None, 7)
    f = fill_int_columns(spark.createDataFrame([(None, None, None)], "source_port long, packet_length long, icmp_type int")).first()
    assert (f.source_port, f.packet_length, f.icmp_type) == (-1, 0, -1)
    c = canonical_columns(spark.createDataFrame([("a", "b", 1, 2)], "src_ip string, dest_ip string, src_port long, dest_port long"))
    assert {"source_ip", "destination_ip", "source_port", "destination_port", "timestamp", "is_source_client"} <= set(c.columns)
    assert c.first().is_source_client is True


def test_tcp_analysis_flags_and_quic(spark):
    df = spark.createDataFrame([(True, False, False, None, True, False, False, "TCP", 80, None),
                                (False, True, False, 2, False, True, False, "UDP", 443, True),
                                (False, False, True, None, False, False, True, "UDP", 53, None)],
                               "tcp_analysis_retransmission boolean, tcp_analysis_fast_retransmission boolean, "
                               "tcp_analysis_duplicate_ack boolean, tcp_analysis_duplicate_ack_num long, "
                               "tcp_analysis_zero_window_probe boolean, tcp_analysis_out_of_order boolean, "
                               "tcp_analysis_window_update boolean, protocol string, destination_port long, quic_layer boolean")
    r = cl.tcp_analysis_flags(df).withColumn("q", cl.is_quic(df)).collect()
    assert r[0].tcp_analysis_retransmission_flags == ["retransmission"]
    assert r[0].tcp_analysis_window_flags == ["zero_window", "zero_window_probe"]
    assert r[1].tcp_analysis_retransmission_flags == ["fast_retransmission"] and r[1].dup_ack_num == 2
    assert r[1].tcp_analysis_duplicate_ack_flags == ["duplicate_ack_num:2"]
    assert r[1].tcp_analysis_out_of_order_flags == ["out_of_order"]
    assert r[2].tcp_analysis_duplicate_ack_flags == ["duplicate_ack"] and r[2].tcp_analysis_window_flags == ["window_update"]
    assert [x.q for x in r] == [None, True, None]
    fast = spark.createDataFrame([(True,)], "tcp_analysis_fast_retransmission boolean")
    assert cl.tcp_analysis_flags(fast).first().dup_ack_num == 3


def test_ids(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3), ("a", 0)], "k string, n long")
    d = {(r.k, r.n): r.flow_id for r in dense_id(df.repartition(3), ["k", "n"]).collect()}
    assert d == {("a", 0): 0, ("a", 1): 1, ("b", 2): 2, ("c", 3): 3}
    h = hash_id(df, ["k", "n"]).collect()
    assert len({r.flow_id for r in h}) == 4


def _pk(spark, rows):
    schema = ("frame_number long, timestamp double, source_ip string, destination_ip string, source_port long, "
              "destination_port long, protocol string, is_source_client boolean, tcp_flags_syn boolean, "
              "tcp_flags_ack boolean, sni string, dns_query_name string, dns_response_addresses array<string>, "
              "http_response_code long")
    return spark.createDataFrame(rows, schema)


def test_app_field_overrides(spark):
    rows = [
        (1, 0.0, "1.1.1.1", "8.8.8.8", 5000, 53, "UDP", True, None, None, None, "ex.com", ["2.2.2.2"], None),
        (2, 1.0, "1.1.1.1", "3.3.3.3", 6000, 443, "TCP", True, True, False, "ex.com", None, None, None),
        (3, 2.0, "1.1.1.1", "4.4.4.4", 7000, 8080, "HTTP", True, False, True, None, None, None, None),
        (4, 2.1, "4.4.4.4", "1.1.1.1", 8080, 7000, "HTTP", False, False, True, None, None, None, 407),
    ]
    df = _pk(spark, rows)
    plain = {(r.server_ip, r.protocol): r.flow_disposition for r in tag_flows(df).collect()}
    app = {(r.server_ip, r.protocol): (r.flow_disposition, r.flow_cause) for r in tag_flows(df, with_app_fields=True).collect()}
    assert plain[("3.3.3.3", "TCP")] == "Unknown" and plain[("4.4.4.4", "HTTP")] == "Unknown"
    assert app[("3.3.3.3", "TCP")][0] == "Mis-routed"
    assert app[("4.4.4.4", "HTTP")] == ("Blocked", "Proxy Authentication Failed")


def test_capture_key_prefix(spark):
    p = packets(spark, SF_SMALL)
    two = p.withColumn("capture_id", F.lit(1)).unionByName(p.withColumn("capture_id", F.lit(2)))
    one = tag_flows(p).count()
    both = tag_flows(two, keys=["capture_id"])
    assert both.count() == 2 * one
    per = {r.capture_id: r["count"] for r in both.groupBy("capture_id").count().collect()}
    assert per == {1: one, 2: one}


def test_key_prefix_isolates_captures_on_random_data(spark, tmp_path):
    """Two random captures analysed together with keys=["capture_id"] give exactly the per-capture
    results (frame numbers overlap between captures, so any leak across captures would show)."""
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
    from random_packets import write
    from netflow_spark.operators import dns, ordered
    from netflow_spark.operators.icmp import icmp_error_counts
    parts = []
    for cid, seed in ((1, 101), (2, 202)):
        path = str(tmp_path / f"c{cid}.parquet")
        write(path, 500, seed)
        parts.append((cid, spark.read.parquet(path)))
    both = parts[0][1].withColumn("capture_id", F.lit(1)).unionByName(parts[1][1].withColumn("capture_id", F.lit(2)))
    ops = [lambda p, k: tag_flows(p, keys=k).drop("flow_id"), lambda p, k: icmp_error_counts(p, k),
           lambda p, k: ordered.handshake_rtt(p, k), lambda p, k: ordered.tcp_heuristics(p, k),
           lambda p, k: ordered.tls_time_to_alert(p, k), lambda p, k: dns.dns_sni_checks(p, k)]
    for op in ops:
        together = op(both, ["capture_id"])
        for cid, p in parts:
            alone = op(p, []).withColumn("capture_id", F.lit(cid))
            mine = together.where(F.col("capture_id") == cid).select(*alone.columns)
            assert mine.exceptAll(alone).count() == 0 and alone.exceptAll(mine).count() == 0


def test_decode_text_codes(spark):
    from netflow_spark.functions.decode import decode_names
    df = spark.createDataFrame([("0x0303", "1", "0x0301", "40", "3"), ("771", None, "772", "2,000", "abc")],
                               "tls_handshake_version_code string, tls_handshake_type_code string, "
                               "tls_record_version_code string, tls_alert_description_code string, dns_rcode string")
    r = decode_names(df).collect()
    assert (r[0].tls_handshake_version, r[0].tls_handshake_type, r[0].tls_effective_version) == ("TLS 1.2", "ClientHello", "TLS 1.2")
    assert (r[0].tls_alert_message_description, r[0].dns_response_code) == ("handshake_failure", "NXDOMAIN")
    assert (r[1].tls_handshake_version, r[1].tls_handshake_type, r[1].tls_effective_version) == ("TLS 1.2", None, "TLS 1.2")
    assert (r[1].tls_alert_message_description, r[1].dns_response_code) == ("2,000", "abc")
    ip = spark.createDataFrame([(6, False), (58, True), (58, False), (99, None)], "p long, v6 boolean")
    from netflow_spark.functions.decode import ip_protocol_name
    assert [x.n for x in ip.select(ip_protocol_name(F.col("p"), F.col("v6"), text=False).alias("n")).collect()] == \
        ["TCP", "ICMPv6", "58", "99"]
