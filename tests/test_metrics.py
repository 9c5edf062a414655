"""Projections and aggregations on the reference's golden inputs."""

import pytest
from pyspark.sql import functions as F

from netflow_spark.functions import classify as cl
from netflow_spark.functions.net import anonymize_ip, vendor_ip_flags
from netflow_spark.functions.normalize import parse_bool_text, parse_int_text
from netflow_spark.operators import enrich, metrics


def test_timeline_and_spikes(spark):
    df = spark.createDataFrame([(1.2, 100), (1.8, 200), (2.4, 50)], "timestamp double, packet_length long")
    tl = {r.second: (r.bytes, r.packets) for r in metrics.timeline(df).collect()}
    assert tl == {1: (300, 2), 2: (50, 1)}

    def spikes(vals, sigma):
        t = spark.createDataFrame(list(enumerate(vals)), "second long, bytes long")
        return sorted(r.second for r in metrics.spikes(t, sigma=sigma).collect())
    assert spikes([10, 12, 11, 100, 9], 1.0) == [3]
    assert spikes([5, 5, 5], 3.0) == []
    assert spikes([], 3.0) == []


def test_rtt_stats(spark):
    s = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "rtt_ms double")
    r = metrics.rtt_stats(s).first()
    assert (r.median, r.min, r.max, r.samples) == (2.5, 1.0, 10.0, 4)
    assert r.p95 == pytest.approx(8.95)
    e = metrics.rtt_stats(s.where("false")).first()
    assert e.samples == 0 and e.reason == "insufficient_syn_ack_pairs" and e.median is None


def test_error_summary(spark):
    df = spark.createDataFrame([("f1", "TCP_RESET", "src1"), ("f2", "TCP_RESET", "src2"),
                                ("f3", "TLS_FATAL_HANDSHAKE_FAILURE", "handshake_failure"),
                                ("f4", "ICMP_DEST_UNREACHABLE_HOST", "host_unreachable")],
                               "flow_id string, flow_error_type string, flow_error_details string")
    res = {(r.error_type, r.error_detail): r for r in metrics.error_summary(df).collect()}
    assert res[("TCP_RESET", "src1")]["count"] == 1 and res[("TCP_RESET", "src1")].sample_flow_ids == ["f1"]
    assert res[("TLS_FATAL_HANDSHAKE_FAILURE", "handshake_failure")]["count"] == 1
    no_detail = df.drop("flow_error_details").drop("flow_id")
    r = {x.error_type: x for x in metrics.error_summary(no_detail).collect()}
    assert r["TCP_RESET"]["count"] == 2 and r["TCP_RESET"].sample_flow_ids == []
    assert metrics.error_total(metrics.error_summary(df)).first().total_errors == 4


def test_security_findings_and_unusual(spark):
    df = spark.createDataFrame([("1", "8.8.8.8", True, False, None), ("2", "3.3.3.3", False, True, "TLS 1.0"),
                                ("3", "5.5.5.5", False, False, None), ("4", "6.6.6.6", False, False, "TLS 1.1")],
                               "flow_id string, destination_ip string, security_flag_plaintext_http boolean, "
                               "security_flag_self_signed_cert boolean, security_flag_outdated_tls_version string")
    f = {(r.finding, r.detail): r.flows for r in metrics.security_findings(df).collect()}
    assert f[("plaintext_http_flows", "")] == 1 and f[("self_signed_certificate_flows", "")] == 1
    assert f[("outdated_tls_version_counts", "TLS 1.0")] == 1 and f[("outdated_tls_version_counts", "TLS 1.1")] == 1
    nets = enrich.networks_table(spark, rows=[("3.3.3.0/24", 0, "IR", "x", 0.0, 0.0, 1, "o"),
                                              ("8.8.8.0/24", 1, "US", "y", 0.0, 0.0, 2, "p")])
    wc = enrich.with_dest_country(df, nets, "destination_ip")
    u = [(r.flow_id, r.country) for r in metrics.unusual_countries(wc).collect()]
    assert u == [("2", "IR")]
    assert metrics.security_total(metrics.security_findings(df), metrics.unusual_countries(wc)).first().security_issues == 5


def test_packet_error_reason(spark):
    df = spark.createDataFrame([("ICMP", 3, 0, False), ("ICMP", 3, 3, False), ("ICMP", 11, 0, False),
                                ("TCP", None, None, True), ("TCP", None, None, False)],
                               "protocol string, icmp_type long, icmp_code long, tcp_flags_rst boolean")
    got = [r.r for r in df.select(cl.packet_error_reason(df).alias("r")).collect()]
    assert got == ["ICMP_Destination_Unreachable", "ICMP_Destination_Unreachable", "ICMP_Time_Exceeded",
                   "TCP_RST_Received", "no_error_detected"]


def test_l7_and_service_guess(spark):
    df = spark.createDataFrame([("UDP", 5000, 443, None), ("TCP", 5000, 80, None), ("TCP", 5000, 443, None),
                                ("UDP", 5000, 53, None), ("UDP", 443, 5000, 1300)],
                               "protocol string, source_port long, destination_port long, first_flight_bytes long")
    got = [r.g for r in df.select(cl.guess_l7(df).alias("g")).collect()]
    assert got == ["QUIC_UDP_443", "HTTP", "HTTPS/TLS", "DNS", "QUIC"]
    s = spark.createDataFrame([("TCP", 443, "example.com", None, None, False), ("UDP", 443, None, None, None, True),
                               ("TCP", 993, None, None, None, False), ("TCP", 25, None, None, "smtp.example.com", False),
                               ("TCP", 5555, None, None, None, False), (None, None, None, None, None, False)],
                              "protocol string, port long, sni string, host string, rdns string, is_quic boolean")
    svc = cl.guess_service(F.col("protocol"), F.col("port"), sni=F.col("sni"), http_host=F.col("host"),
                           rdns=F.col("rdns"), is_quic=F.col("is_quic"))
    assert [r.s for r in s.select(svc.alias("s")).collect()] == ["example.com", "QUIC", "IMAPS", "smtp", "TCP/5555",
                                                                 "Unknown Service"]


def test_top_flows_score_order(spark):
    df = spark.createDataFrame([("a", "Allowed", None, 1000), ("b", "Blocked", "alert", 10), ("c", "Degraded", None, 10)],
                               "k string, flow_disposition string, security_observation string, bytes_total long")
    assert [r.k for r in metrics.top_flows(df, ["k"]).collect()] == ["b", "c", "a"]


def test_anonymize_and_vendor_flags(spark):
    df = spark.createDataFrame([("192.168.1.42", "104.129.192.1", "8.8.8.8"), ("2001:db8:abcd:0::1", "1.1.1.1", "100.64.0.1")],
                               "ip string, source_ip string, destination_ip string")
    assert [r.a for r in df.select(anonymize_ip(F.col("ip")).alias("a")).collect()] == ["192.168.1.0", "2001:db8:abcd::"]
    v = vendor_ip_flags(df).collect()
    assert (v[0].is_zscaler_ip, v[0].is_zpa_synthetic_ip) == (True, False)
    assert (v[1].is_zscaler_ip, v[1].is_zpa_synthetic_ip) == (False, True)
    with pytest.raises(Exception):
        spark.createDataFrame([("bogus",)], "ip string").select(anonymize_ip(F.col("ip"))).collect()


def test_parse_text_and_severity(spark):
    df = spark.createDataFrame([("1,234",), ("-1,234",), (" 42 ",), ("3.14",), ("bad",), ("0x1F",), ("010",), ("0",)], "s string")
    assert [r.v for r in df.select(parse_int_text(F.col("s")).alias("v")).collect()] == [1234, -1234, 42, None, None, 31, None, 0]
    b = spark.createDataFrame([("true",), ("1",), ("False",), ("0",), ("x",)], "s string")
    assert [r.v for r in b.select(parse_bool_text(F.col("s")).alias("v")).collect()] == [True, True, False, False, None]
    r = spark.createDataFrame([(0.5,), (1.5,), (5.0,)], "x double")
    assert [x.s.status for x in r.select(cl.retransmission_severity(F.col("x")).alias("s")).collect()] == ["Healthy", "Warning", "Critical"]


def test_path_mtu_and_sparkline_stats(spark):
    df = spark.createDataFrame([("ICMP", 3, 4, None, 1400)], "protocol string, icmp_type long, icmp_code long, icmp_mtu long, icmp_nexthop_mtu long")
    assert df.select(cl.path_mtu(df).alias("m")).first().m == 1400
    s = spark.createDataFrame([("100,0,50",), ("",)], "s string").select(cl.sparkline_stats(F.col("s")).alias("x")).collect()
    assert (s[0].x["min"], s[0].x["max"], s[0].x["mean"]) == (0, 100, 50.0) and s[1].x is None


def test_enrichment_lookups(spark):
    nets = enrich.networks_table(spark, rows=[("1.2.0.0/16", 0, "TL", "Exampleville", 1.23, 4.56, 12345, "TestOrg"),
                                              ("1.2.3.0/24", 1, "TL", "Exampleville", 1.23, 4.56, 12345, "TestOrg")])
    ips = spark.createDataFrame([("1.2.3.4",), ("9.9.9.9",)], "ip string")
    g = {r.ip: r for r in enrich.ip_geo(ips, nets).collect()}
    assert (g["1.2.3.4"].city, g["1.2.3.4"].latitude, g["1.2.3.4"].longitude) == ("Exampleville", 1.23, 4.56)
    assert g["9.9.9.9"].city is None
    a = {r.ip: r for r in enrich.ip_asn(ips, nets).collect()}
    assert (a["1.2.3.4"].asn_number, a["1.2.3.4"].asn_organization) == (12345, "TestOrg")
    rd = enrich.ip_rdns(ips, spark.createDataFrame([("1.2.3.4", "host.example")], "ip string, rdns string"))
    assert {r.ip: r.rdns for r in rd.collect()} == {"1.2.3.4": "host.example", "9.9.9.9": None}


def test_exact_quantiles_grouped_matches_numpy(spark):
    import random

    import numpy as np

    from netflow_spark.operators.quantiles import exact_quantiles
    rnd = random.Random(7)
    rows = [(g, rnd.random() * 100) for g in ("a", "b", "c") for _ in range(rnd.randint(1, 60))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.q0, r.q1, r.q2) for r in exact_quantiles(df, "v", [0.5, 0.95, 0.0], keys=["g"]).collect()}
    for g in ("a", "b", "c"):
        vals = np.array([v for k, v in rows if k == g])
        assert got[g][0] == len(vals)
        assert got[g][1] == pytest.approx(np.percentile(vals, 50))
        assert got[g][2] == pytest.approx(np.percentile(vals, 95))
        assert got[g][3] == pytest.approx(vals.min())


def test_longest_prefix_matches_brute_force(spark):
    import ipaddress
    import random

    rnd = random.Random(11)
    nets = set()
    while len(nets) < 60:
        p = rnd.choice([0, 4, 8, 12, 15, 16, 20, 23, 24, 27, 30, 32])
        a = rnd.choice([10, 172, 192]) << 24 | rnd.getrandbits(24) if p >= 8 else rnd.getrandbits(32)
        nets.add(str(ipaddress.ip_network((a, p), strict=False)))
    rows = [(n, i, "XX", f"c{i}", 0.0, 0.0, i, f"o{i}") for i, n in enumerate(sorted(nets))]
    ips = [str(ipaddress.ip_address(rnd.choice([10, 172, 192]) << 24 | rnd.getrandbits(24))) for _ in range(300)]
    six = [str(ipaddress.ip_network((0x20010DB8 << 96 | rnd.getrandbits(96), p), strict=False)) for p in (32, 33, 40, 48, 56, 63, 64, 65, 96, 112, 113, 127, 128)]
    six += [str(ipaddress.ip_network((int(ipaddress.ip_address("2001:db8:5::")), p), strict=False)) for p in (0, 16, 47, 48, 61, 64)]
    nets |= set(six)
    rows = [(n, i, "XX", f"c{i}", 0.0, 0.0, i, f"o{i}") for i, n in enumerate(sorted(nets))]
    ips += [str(ipaddress.ip_network(n).network_address + rnd.randrange(min(ipaddress.ip_network(n).num_addresses, 1 << 70))) for n in sorted(nets) for _ in range(3)]
    ips += ["not-an-ip", "::1", "2001:DB8:5::1", "2001:db8:5:0:0:0:0:2", "::ffff:10.0.0.1"]
    got = {r.ip: r.network for r in enrich.longest_prefix(spark.createDataFrame([(i,) for i in ips], "ip string"),
                                                          enrich.networks_table(spark, rows=rows)).collect()}
    parsed = [ipaddress.ip_network(n) for n in nets]
    for ip in ips:
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            assert got[ip] is None
            continue
        cands = [n for n in parsed if a in n]
        exp = str(max(cands, key=lambda n: n.prefixlen)) if cands else None
        assert got[ip] == exp, ip
