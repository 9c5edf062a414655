"""Flow construction, dispositions, joins and ordered analytics on an invented office capture."""

import pytest
from pyspark.sql import functions as F

from netflow_spark.fixtures import packets
from netflow_spark.functions.columns import with_oriented_key
from netflow_spark.operators import disposition, dns, features, flow_table, icmp, metrics, ordered, orient
from netflow_spark.sources.io import conform
from tests.captures import DESK, NAS, PRINTER, PROXY, RESOLVER, SHOP, Capture, office
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def day(spark):
    return office().frame(spark)


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_dispositions(day):
    got = {(r.server_ip, r.server_port): (r.flow_disposition, r.flow_cause) for r in disposition.tag_flows(day).collect()}
    assert got[PRINTER, 9100] == ("Allowed", "Completed TCP session with data exchange")
    assert got[NAS, 22] == ("Blocked", "TCP RST from destination after SYN")
    assert got["198.18.7.88", 873] == ("Degraded", "Downstream ICMP errors")
    assert got[SHOP, 443] == ("Blocked", "TLS Handshake Failure")
    assert got[PROXY, 3128] == ("Unknown", "Undetermined")
    assert got["192.168.50.77", 0] == ("Degraded", "ICMP Destination Unreachable/Time Exceeded in flow")


def test_ids_are_the_places_of_the_sorted_keys(day):
    rows = disposition.tag_flows(day).collect()
    key = [(r.client_ip, r.server_ip, r.client_port, r.server_port, r.protocol) for r in sorted(rows, key=lambda r: r.flow_id)]
    assert key == sorted(key) and sorted(r.flow_id for r in rows) == list(range(len(rows)))


def test_tls_outcome(day):
    r = disposition.tag_flows(day).where(F.col("server_ip") == SHOP).first()
    assert r.tls_handshake_ok is False and r.first_alert_time == 40.6 and r.time_to_alert == pytest.approx(0.5)


def test_application_evidence(spark, day):
    """With application fields the proxy's 407 and a server outside of the DNS answer count."""
    c = office()
    c.packet(61.0, DESK, "198.18.7.99", 40777, 443, flags="s", sni="files.test")
    got = {r.server_ip: r.flow_disposition for r in disposition.tag_flows(c.frame(spark), with_app_fields=True).collect()}
    assert got[PROXY] == "Blocked" and got["198.18.7.99"] == "Mis-routed" and got[PRINTER] == "Allowed"


def test_names_and_connections(spark):
    """A connection is checked against the answers of the minute before it, by client and name."""
    c = Capture()
    for client, at, ip in ((DESK, 100.0, NAS), (DESK, 130.0, "198.18.9.1"), (PRINTER, 100.0, "198.18.9.2")):
        c.packet(at, client, RESOLVER, 5000, 53, "UDP", dns_query_name="files.test", dns_response_addresses=[ip])
    tries = [(DESK, 150.0, NAS), (DESK, 150.0, "198.18.9.9"), (DESK, 165.0, NAS), (DESK, 165.0, "198.18.9.1"), (DESK, 191.0, NAS), (PRINTER, 110.0, NAS)]
    for client, at, server in tries:
        c.packet(at, client, server, 6000, 443, sni="files.test")
    rows = {r.frame_number: r.mismatch for r in dns.dns_sni_checks(c.frame(spark)).collect()}
    assert rows == {4: False, 5: True, 6: True, 7: False, 9: True}


def test_flow_table_and_sparklines(spark):
    c = Capture()
    say = c.talk(DESK, PRINTER, 41000, 80)
    for at, size, back in ((5.25, 70, False), (5.75, 30, False), (7.0, 500, True), (8.9, 11, False)):
        say(at, "", back, packet_length=size)
    c.packet(6.0, DESK, PRINTER, None, None, "TCP", packet_length=None)
    df = c.frame(spark)
    got = {r.src_port: r for r in flow_table.flow_table(df).collect()}
    r = got[41000]
    assert (r.bytes_c2s, r.bytes_s2c, r.bytes_total, r.pkts_c2s, r.pkts_s2c, r.start_ts, r.end_ts, r.l7_protocol_guess) == (111, 500, 611, 3, 1, 5.25, 8.9, "HTTP")
    assert (got[0].dest_port, got[0].bytes_total, got[0].pkts_total) == (0, 0, 1)
    lines = {r.src_port: (r.sparkline_bytes_c2s, r.sparkline_bytes_s2c) for r in flow_table.flow_sparklines(df).collect()}
    assert lines[41000] == ("100,0,0,11", "0,0,500,0")
    keys = {r.k for r in df.select(orient.flow_key(df).alias("k")).collect()}
    assert keys == {f"TCP_{DESK}:41000_{PRINTER}:80", f"TCP_{DESK}:0_{PRINTER}:0"}


def test_packets_without_a_timestamp(spark):
    """They count, but set no time: neither the flow's start nor a second of its sparkline. No row per second between."""
    c = Capture()
    say = c.talk(DESK, PRINTER, 41000, 80)
    for at, size, back in ((1_700_000_000.5, 70, False), (None, 30, False), (1_700_000_004.0, 5, True), (None, 9, True)):
        say(at, "", back, packet_length=size)
    only = c.talk(DESK, NAS, 42000, 22)
    only(None, "", False, packet_length=8)
    only(None, "", False, packet_length=2)
    far = c.talk(DESK, NAS, 43000, 22)
    far(0.0, "", False, packet_length=4)
    far(300_000.0, "", False, packet_length=6)
    df = c.frame(spark)
    t = {r.src_port: (r.bytes_total, r.pkts_total, r.start_ts, r.end_ts) for r in flow_table.flow_table(df).collect()}
    assert t == {41000: (114, 4, 1_700_000_000.5, 1_700_000_004.0), 42000: (10, 2, 0.0, 0.0), 43000: (10, 2, 0.0, 300_000.0)}
    lines = {r.src_port: (r.sparkline_bytes_c2s, r.sparkline_bytes_s2c) for r in flow_table.flow_sparklines(df).collect()}
    assert lines[41000] == ("70,0,0,0,0", "0,0,0,0,5") and lines[42000] == ("10", "")
    assert lines[43000] == ("4," + "0," * 299_999 + "6", "")


def test_spike_flows_over_any_time_span(spark):
    """Dyadic blocks against brute force; a flow from 0 to 1.7e9 makes few rows, and blocks hold each second once."""
    import random

    from netflow_spark.operators.joins import dyadic_blocks, spike_top_flows
    rng = random.Random(8)
    spans = [(0.0, 1.7e9), (-5.5, 3.25), (7.2, 7.9), (8.0, 8.0), (None, 9.0), (4.0, None), (float("-inf"), float("inf")), (9.0, 2.0)]
    spans += [(a := rng.uniform(-50, 200), a + rng.choice([0.0, 0.4, 3.0, 60.0, 1e6])) for _ in range(150)]
    flows = [(f"c{i % 3}", f"f{i:03d}", a, b, rng.randrange(40)) for i, (a, b) in enumerate(spans)]
    seconds = [(f"c{i % 3}", s) for i, s in enumerate([-5, -1, 0, 1, 7, 8, 9, 64, 127, 128, 150, 1_000_000, 1_699_999_999, 1_700_000_001])]
    f = spark.createDataFrame(flows, "cap string, flow string, start_ts double, end_ts double, bytes_total long")
    s = spark.createDataFrame(seconds, "cap string, second long")
    want = []
    for cap, sec in seconds:
        active = [x for x in flows if x[0] == cap and x[2] is not None and x[3] is not None and x[2] <= sec <= x[3]]
        want += [(cap, sec, k + 1, x[1], x[4]) for k, x in enumerate(sorted(active, key=lambda x: (-x[4], x[1]))[:5])]
    assert sorted(map(tuple, spike_top_flows(s, f, ["flow"], keys=["cap"]).collect())) == sorted(want)
    longest = f.where("flow = 'f000'").select(F.explode(dyadic_blocks(F.col("start_ts").cast("long"), F.col("end_ts").cast("long"))).alias("b")).select("b.*").collect()
    assert len(longest) < 100
    at = 0
    for level, block in sorted((tuple(r) for r in longest), key=lambda r: r[1] << r[0]):
        assert block << level == at
        at += 1 << level
    assert at == 1_700_000_001


def test_orientation(spark):
    c = Capture()
    say = c.talk(DESK, NAS, 42000, 22)
    say(1.0, "a")
    say(1.1, "s")
    say(1.2, "sa", True)
    say(1.3, "a")
    df = c.frame(spark).drop("is_source_client")
    assert [r.is_source_client for r in orient.orient_packets(df).orderBy("frame_number").collect()] == [True, True, False, True]
    assert [r.is_src_client for r in orient.orient_parser(df).orderBy("frame_number").collect()] == [None, True, None, True]
    partly = df.withColumn("is_src_client", F.when(F.col("frame_number") == 4, False))
    assert [r.is_source_client for r in orient.ensure_direction(partly).orderBy("frame_number").collect()] == [True, True, False, False]


def test_handshake_and_alert_times(day):
    assert [r.rtt_ms for r in ordered.handshake_rtt(day).collect()] == [pytest.approx(30.0)]
    assert [r.tcp_rtt_ms for r in ordered.packet_rtt(day).collect()] == [pytest.approx(30.0)]
    assert [r.time_to_alert_ms for r in ordered.tls_time_to_alert(day).collect()] == [pytest.approx(500.0)]


def heuristics_by_hand(rows, history=64):
    """W1 packet by packet, from lists."""
    past, out = {}, {}
    for f, key, seq, ack, win, size in rows:
        before = past.setdefault(key, [])
        seen = seq is not None and seq in [b[0] for b in before[-history:]]
        last = before[-1] if before else None
        out[f] = (seen, last is not None and ack is not None and ack == last[1] and size == 0,
                  last is not None and seq is not None and seq < (last[0] or 0) + last[3] and not seen,
                  last is not None and win == 0 and last[2] is not None and last[2] != 0)
        before.append((seq, ack, win, size))
    return out


@pytest.mark.parametrize("block", [1 << 20, 150, 7, 1])
def test_tcp_heuristics_by_hand(spark, block):
    """Whatever the block size: history and previous packet are carried across blocks."""
    import random
    rng = random.Random(12)
    c, rows = Capture(), []
    for f in range(1, 701):
        flow = rng.choice((0, 0, 0, 1))
        seq = rng.choice((None, rng.randrange(60), rng.randrange(60), f * 10))
        ack, win, size = rng.choice((None, 1, 2)), rng.choice((None, 0, 900)), rng.choice((0, 0, 25))
        c.packet(float(f), DESK, NAS, 43000 + flow, 22, tcp_sequence_number=seq, tcp_acknowledgment_number=ack, tcp_window_size=win, tcp_payload_length=size)
        rows.append((f, flow, seq, ack, win, size))
    got = {r.frame_number: (r.heuristic_retransmission, r.heuristic_duplicate_ack, r.heuristic_out_of_order, r.heuristic_zero_window)
           for r in ordered.tcp_heuristics(c.frame(spark), block=block).collect()}
    assert got == heuristics_by_hand(rows)


def test_results_do_not_depend_on_the_block_size(spark):
    p = packets(spark, SF_SMALL)
    for fn, block in ((ordered.packet_rtt, 5), (ordered.handshake_rtt, 5), (ordered.tls_time_to_alert, 5), (icmp.icmp_error_counts, 3)):
        assert fn(p).count() > 0 and same(fn(p), fn(p, block=block)), fn.__name__
        assert same(fn(p), fn(p, keys=())), fn.__name__


def test_flow_summary(spark):
    c = Capture()
    say = c.talk(DESK, NAS, 44000, 80)
    say(1.0, packet_length=10, http_request_host_header="nas.test", http_request_uri="/a", dns_query_name="other.test", dns_response_code="NXDOMAIN")
    say(3.5, "", True, packet_length=70, dns_query_name="nas.test", dns_response_code="NOERROR", dns_response_addresses=["192.0.2.4", NAS])
    say(2.0, packet_length=20, http_request_uri="/b", sni="nas.test")
    c.packet(9.0, None, NAS, 1, 2)
    tags = spark.createDataFrame([(1, "Unknown", "TCP", "late; early"), (2, "Degraded", "DNS", None), (3, "Allowed", "HTTP", "early")],
                                 "frame_number long, flow_disposition string, traffic_type_guess string, security_observation string")
    rows = flow_table.flow_summary(c.frame(spark).join(tags, "frame_number", "left")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.src_ip, r.dest_ip, r.pkts_c2s, r.pkts_s2c, r.bytes_c2s, r.bytes_s2c, r.duration_ms) == (DESK, NAS, 2, 1, 30, 70, 2500.0)
    assert (r.flow_disposition, r.primary_traffic_type_guess, r.security_observations) == ("Degraded", "HTTP", "early;late")
    assert (r.sni_hostname, r.http_host, r.http_path, r.dns_query, r.dns_response_code) == ("nas.test", "nas.test", "/a", "nas.test", "NOERROR")


def test_errors_and_findings_count_flows(day):
    """Each flow once, however many of its packets show the same."""
    doubled = day.unionByName(day.withColumn("frame_number", F.col("frame_number") + 1000))
    for df in (day, doubled):
        tagged = features.tagged_flows(df)
        errors = {(r.error_type, r.error_detail): (r["count"], len(r.sample_flow_ids)) for r in metrics.error_summary(tagged).collect()}
        assert errors == {("TCP_RESET", f"Source: {NAS}"): (1, 1), ("TLS_FATAL_bad_certificate", "bad_certificate"): (1, 1),
                          ("ICMP_DEST_UNREACHABLE_HOST", "Source: 192.168.50.77"): (1, 1)}
        found = {(r.finding, r.detail): r.flows for r in metrics.security_findings(tagged).collect()}
        assert found == {("plaintext_http_flows", ""): 0, ("self_signed_certificate_flows", ""): 0, ("outdated_tls_version_counts", "TLS 1.0"): 1}


@pytest.mark.parametrize("rename", [None, "is_src_client"])
def test_conformed_tables_answer_alike(spark, rename):
    """Columns are chosen by their data: null schema columns beside them change nothing."""
    raw = packets(spark, SF_SMALL).drop("dns_response_addresses_csv")
    full = conform(raw.withColumnRenamed("is_source_client", rename) if rename else raw, fill=True)
    assert {"is_source_client", "is_src_client", "tcp_analysis_retransmission_flags"} <= set(full.columns)
    assert same(disposition.tag_flows(raw), disposition.tag_flows(full))
    assert same(ordered.retransmissions(raw), ordered.retransmissions(full))
    assert same(features.rule_features(raw), features.rule_features(full))
    assert same(flow_table.flow_table(raw), flow_table.flow_table(full))

    def performance(p):
        return metrics.performance_summary(ordered.handshake_rtt(p), ordered.tls_time_to_alert(p), ordered.retransmissions(p), p)
    assert same(performance(raw), performance(full)) and performance(full).first().tcp_retransmission_ratio_percent > 0


def test_retransmission_flags_count_per_packet(spark):
    c = Capture()
    for _ in range(3):
        c.packet(1.0, DESK, NAS, 45000, 22, "tcp", tcp_sequence_number=5)
    flags = spark.createDataFrame([(1, ["retransmission"]), (2, []), (3, None)], "frame_number long, tcp_analysis_retransmission_flags array<string>")
    got = ordered.retransmissions(c.frame(spark).join(flags, "frame_number"))
    assert {r.frame_number: r.heuristic_retransmission for r in got.collect()} == {1: True, 2: False, 3: True}


def test_no_direction_at_all(day):
    with pytest.raises(ValueError):
        disposition.tag_flows(day.drop("is_source_client"))
    assert with_oriented_key(day.withColumn("is_source_client", F.lit(None).cast("boolean"))).where("client_ip = source_ip").count() == 0
