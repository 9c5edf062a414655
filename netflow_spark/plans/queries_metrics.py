"""Registered projection, aggregation, top-k, enrichment and interval-join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import addresses, http_packets, networks, packets, table, two_captures
from ..functions import classify as cl
from ..functions.decode import decode_names
from ..functions.net import anonymize_ip, vendor_ip_flags
from ..functions.normalize import fill_int_columns
from ..operators import dns, enrich, metrics, ordered
from ..operators import flow_table as ft
from ..operators import disposition as disp
from ..operators.disposition import tag_flows
from ..operators.features import rule_features, tagged_flows
from ..operators.flows import flow_facts, signals_from_facts
from ..operators.ids import dense_id
from ..operators.joins import spike_top_flows
from ..operators.orient import flow_key
from ..rules import default_rules, tag
from ..schema import FLOW_KEY
from ..sources.io import conform, slice_frames
from .queries_rules import rule_input
from .registry import query

TABLE_KEY = ft.TABLE_KEY


# ---- projections -------------------------------------------------------------------------------

@query("fill_ints")
def q_fill_ints(spark: SparkSession, sf: str) -> DataFrame:
    return fill_int_columns(packets(spark, sf)).select(
        "frame_number", "source_port", "destination_port", "packet_length", "tcp_sequence_number",
        "tcp_acknowledgment_number", "tcp_window_size", "icmp_type", "icmp_code")


def decode_input(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric protocol codes derived from ``events`` (known and unknown codes)."""
    e = table(spark, sf, "events")
    ver = F.when(~F.col("event_type").isin("view", "click"), F.lit(766) + F.col("event_id") % 8)
    return e.select(
        "event_id",
        (F.col("event_id") % 64).alias("ip_protocol"),
        (F.col("event_id") % 260).alias("dns_query_type_code"),
        (F.col("user_id") % 8).alias("dns_rcode"),
        (F.col("user_id") % 10).alias("dhcp_message_type_code"),
        (F.col("event_id") % 27).alias("tls_handshake_type_code"),
        ver.alias("tls_handshake_version_code"),
        (F.lit(767) + F.col("user_id") % 6).alias("tls_record_version_code"),
        (F.col("user_id") % 4).alias("tls_alert_level_code"),
        (F.floor("value") % 120).cast("long").alias("tls_alert_description_code"))


@query("decode_names")
def q_decode_names(spark: SparkSession, sf: str) -> DataFrame:
    return decode_names(decode_input(spark, sf)).select(
        "event_id", "protocol", "dns_query_type", "dns_response_code", "dhcp_message_type", "tls_handshake_type",
        "tls_handshake_version", "tls_record_version", "tls_effective_version", "tls_alert_level",
        "tls_alert_message_description")


@query("vendor_ip_flags")
def q_vendor_ip_flags(spark: SparkSession, sf: str) -> DataFrame:
    return vendor_ip_flags(packets(spark, sf)).select(
        "frame_number", "source_ip", "destination_ip", "is_zscaler_ip", "is_zpa_synthetic_ip")


@query("packet_error")
def q_packet_error(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    return p.select("frame_number", cl.packet_error_reason(p).alias("packet_error_reason"))


@query("l7_guess")
def q_l7_guess(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf).withColumn("first_flight_packet_size", F.col("packet_length"))
    return p.select("frame_number", cl.guess_l7(p).alias("l7_protocol_guess"))


@query("service_guess")
def q_service_guess(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    return metrics.with_service(p, enrich.passive_rdns(p)).select("frame_number", "service")


@query("anonymize_ip")
def q_anonymize_ip(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    return p.select("frame_number", anonymize_ip(F.col("source_ip"), on_invalid="null").alias("source_network"),
                    anonymize_ip(F.col("destination_ip"), on_invalid="null").alias("destination_network"))


@query("retrans_severity")
def q_retrans_severity(spark: SparkSession, sf: str) -> DataFrame:
    rf = rule_features(packets(spark, sf)).where(F.col("tcp_retransmission_rate_percent").isNotNull())
    sev = cl.retransmission_severity(F.col("tcp_retransmission_rate_percent"))
    return rf.select(*FLOW_KEY, "tcp_retransmission_rate_percent", sev["status"].alias("status"),
                     sev["color"].alias("color"))


@query("sparkline_stats")
def q_sparkline_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = ft.flow_sparklines(packets(spark, sf))
    st = cl.sparkline_stats(F.col("sparkline_bytes_c2s"))
    return s.where(F.col("sparkline_bytes_c2s") != "").select(
        *TABLE_KEY, st["min"].alias("c2s_min"), st["max"].alias("c2s_max"), st["mean"].alias("c2s_mean"))


# ---- sources / sinks shaped as queries -------------------------------------------------------

@query("slice_frames")
def q_slice_frames(spark: SparkSession, sf: str) -> DataFrame:
    return slice_frames(packets(spark, sf), start=100, size=5000, max_packets=2000).select(
        "frame_number", "timestamp", "source_ip", "destination_ip", "protocol", "packet_length")


@query("flow_records_json")
def q_flow_records_json(spark: SparkSession, sf: str) -> DataFrame:
    t = tag_flows(packets(spark, sf), flow_id="hash")
    rec = F.to_json(F.struct(*FLOW_KEY, "flow_disposition", "flow_cause", "icmp_error_count"))
    return t.select(rec.alias("record"))


# ---- rules over flows -----------------------------------------------------------------------

@query("filter_l7")
def q_filter_l7(spark: SparkSession, sf: str) -> DataFrame:
    f = ft.flow_table(packets(spark, sf))
    return f.where(F.col("l7_protocol_guess").isin("HTTP", "HTTPS/TLS")).select(
        *TABLE_KEY, "l7_protocol_guess", "bytes_total")


@query("rule_features")
def q_rule_features(spark: SparkSession, sf: str) -> DataFrame:
    return rule_features(packets(spark, sf))


def outcome_flows(spark: SparkSession, sf: str) -> DataFrame:
    return tag(rule_features(packets(spark, sf)), default_rules())


@query("rules_outcome")
def q_rules_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return outcome_flows(spark, sf).select(*FLOW_KEY, "flow_disposition", "security_observation", "flow_outcome")


# ---- joins -------------------------------------------------------------------------------------

@query("dns_sni_mismatch")
def q_dns_sni_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return dns.dns_sni_checks(packets(spark, sf))


@query("ip_geo")
def q_ip_geo(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.ip_geo(addresses(spark, sf), networks(spark, sf))


@query("ip_asn")
def q_ip_asn(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.ip_asn(addresses(spark, sf), networks(spark, sf))


@query("ip_rdns")
def q_ip_rdns(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    return enrich.ip_rdns(p.select(F.col("destination_ip").alias("ip")), enrich.passive_rdns(p))


@query("enrich_ips")
def q_enrich_ips(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich_ips(addresses(spark, sf), networks(spark, sf), enrich.passive_rdns(packets(spark, sf)))


@query("spike_top_flows")
def q_spike_top_flows(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    sp = metrics.spikes(metrics.timeline(p))
    return spike_top_flows(sp, ft.flow_table(p), TABLE_KEY)


# ---- aggregations ------------------------------------------------------------------------------

@query("protocol_counts")
def q_protocol_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.protocol_counts(packets(spark, sf))


@query("top_ports")
def q_top_ports(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_ports(packets(spark, sf))


@query("tls_versions")
def q_tls_versions(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.tls_versions(packets(spark, sf))


@query("timeline")
def q_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.timeline(packets(spark, sf))


@query("timeline_spikes")
def q_timeline_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.spikes(metrics.timeline(packets(spark, sf)))


@query("rtt_stats")
def q_rtt_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rtt_stats(ordered.handshake_rtt(packets(spark, sf)))


@query("performance_summary")
def q_performance_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    return metrics.performance_summary(ordered.handshake_rtt(p), ordered.tls_time_to_alert(p),
                                       ordered.retransmissions(p), p)


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    return ft.flow_summary(tag(rule_input(spark, sf), default_rules()))


@query("service_overview")
def q_service_overview(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    return metrics.service_overview(_summary(spark, sf), rdns=enrich.passive_rdns(p))


@query("error_summary")
def q_error_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.error_summary(tagged_flows(packets(spark, sf)))


@query("error_rows")
def q_error_rows(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.error_rows(metrics.error_summary(tagged_flows(packets(spark, sf))))


@query("error_total")
def q_error_total(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.error_total(metrics.error_summary(tagged_flows(packets(spark, sf))))


@query("security_findings")
def q_security_findings(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.security_findings(tagged_flows(packets(spark, sf)))


def _unusual(spark: SparkSession, sf: str) -> DataFrame:
    f = ft.flow_table(packets(spark, sf))
    f = enrich.with_dest_country(f, networks(spark, sf), "dest_ip")
    return f.where("is_unusual_country").select(*TABLE_KEY, "dest_country")


@query("unusual_countries")
def q_unusual_countries(spark: SparkSession, sf: str) -> DataFrame:
    return _unusual(spark, sf)


@query("security_total")
def q_security_total(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.security_total(metrics.security_findings(tagged_flows(packets(spark, sf))), _unusual(spark, sf))


@query("plaintext_flows")
def q_plaintext_flows(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.plaintext_flows(packets(spark, sf))


@query("outcome_by_protocol")
def q_outcome_by_protocol(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.outcome_by_protocol(outcome_flows(spark, sf))


@query("errors_by_reason")
def q_errors_by_reason(spark: SparkSession, sf: str) -> DataFrame:
    p = metrics.errors_input(packets(spark, sf))
    rows = p.select("packet_error_reason", flow_key(p).alias("flow_id"),
                    F.col("packet_length").alias("total_bytes"), F.col("timestamp").alias("first_ts"))
    return metrics.errors_by_reason(rows)


@query("capture_info")
def q_capture_info(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.capture_info(packets(spark, sf))


# ---- top-k -------------------------------------------------------------------------------------

@query("top_by_bytes")
def q_top_by_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_by(ft.flow_table(packets(spark, sf)), "bytes_total", TABLE_KEY)


@query("top_by_packets")
def q_top_by_packets(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top_by(ft.flow_table(packets(spark, sf)), "pkts_total", TABLE_KEY)


@query("top_flows")
def q_top_flows(spark: SparkSession, sf: str) -> DataFrame:
    t = metrics.top_flows(_summary(spark, sf), TABLE_KEY)
    return t.select(*TABLE_KEY, "flow_disposition", "security_observations", "bytes_total", "score")


@query("summary_sorted")
def q_summary_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """T4: the summary with each row's place in start-time order."""
    order = ["start_time", *TABLE_KEY]
    return dense_id(_summary(spark, sf), order, name="place").select("place", *order)


# ---- dispositions on input where every rule fires ------------------------------------------------

@query("proxy_407")
def q_proxy_407(spark: SparkSession, sf: str) -> DataFrame:
    p = http_packets(spark, sf)
    return p.select("frame_number", disp.proxy_407(p).alias("is_proxy_407"))


@query("flow_disposition")
def q_flow_disposition(spark: SparkSession, sf: str) -> DataFrame:
    flows = signals_from_facts(flow_facts(http_packets(spark, sf)), extra=["_any_407"])
    flows = flows.withColumn("http_status", F.when(F.col("_any_407"), F.lit(407)))
    return disp.flow_disposition(flows).select(*FLOW_KEY, "flow_disposition", "flow_cause")


# ---- several captures in one table: nothing may mix ------------------------------------------------

CAPTURE = ["capture_id"]


def _performance(p: DataFrame) -> DataFrame:
    return metrics.performance_summary(ordered.handshake_rtt(p, CAPTURE), ordered.tls_time_to_alert(p, CAPTURE),
                                       ordered.retransmissions(p, CAPTURE), p, CAPTURE)


BY_CAPTURE = {
    "capture_info": lambda p: metrics.capture_info(p, CAPTURE),
    "top_ports": lambda p: metrics.top_ports(p, keys=CAPTURE),
    "timeline_spikes": lambda p: metrics.spikes(metrics.timeline(p, CAPTURE), keys=CAPTURE),
    "spike_top_flows": lambda p: spike_top_flows(metrics.spikes(metrics.timeline(p, CAPTURE), keys=CAPTURE),
                                                 ft.flow_table(p, CAPTURE), TABLE_KEY, keys=CAPTURE),
    "top_by_bytes": lambda p: metrics.top_by(ft.flow_table(p, CAPTURE), "bytes_total", TABLE_KEY, keys=CAPTURE),
    "performance_summary": _performance,
    "rtt_stats": lambda p: metrics.rtt_stats(ordered.handshake_rtt(p, CAPTURE), keys=CAPTURE),
    "error_summary": lambda p: metrics.error_summary(tagged_flows(p, keys=CAPTURE), keys=CAPTURE),
    "error_total": lambda p: metrics.error_total(metrics.error_summary(tagged_flows(p, keys=CAPTURE), keys=CAPTURE), CAPTURE),
    "security_findings": lambda p: metrics.security_findings(tagged_flows(p, keys=CAPTURE), CAPTURE),
    "plaintext_flows": lambda p: metrics.plaintext_flows(p, CAPTURE),
    "rule_features": lambda p: rule_features(p, CAPTURE),
    "tcp_heuristics": lambda p: ordered.tcp_heuristics(p, CAPTURE),
}

for _name, _report in BY_CAPTURE.items():
    query(f"{_name}_by_capture")(lambda spark, sf, report=_report: report(two_captures(spark, sf)))


@query("conformed_tag_flows")
def q_conformed_tag_flows(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship on a table conformed to the whole packet schema, with the direction in the
    parser's column only."""
    p = packets(spark, sf).withColumnRenamed("is_source_client", "is_src_client").drop("dns_response_addresses_csv")
    return tag_flows(conform(p, fill=True))


@query("conformed_retransmissions")
def q_conformed_retransmissions(spark: SparkSession, sf: str) -> DataFrame:
    """Retransmissions of a conformed table: the dissector's flags on some packets, W1 on the rest."""
    p = packets(spark, sf)
    p = p.withColumn("tcp_analysis_retransmission_flags", F.expr(
        "CASE frame_number % 50 WHEN 3 THEN array('retransmission') WHEN 4 THEN cast(array() AS array<string>) END"))
    return ordered.retransmissions(conform(p, fill=True))
