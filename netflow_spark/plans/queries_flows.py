"""Registered flow-construction, join and ordered-analytics queries (G, J1–J3, W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import packets
from ..operators import flows as fl
from ..operators import flow_table as ft
from ..operators import icmp, ordered
from ..operators import orient as ori
from ..rules import default_rules, tag
from ..schema import FLOW_KEY
from .queries_rules import rule_input
from .registry import query


@query("flow_key")
def q_flow_key(spark: SparkSession, sf: str) -> DataFrame:
    p = packets(spark, sf)
    return p.select("frame_number", ori.flow_key(p).alias("flow_key"))


@query("orient")
def q_orient(spark: SparkSession, sf: str) -> DataFrame:
    return ori.orient_packets(packets(spark, sf)).select("frame_number", "flow_key", "is_source_client")


@query("orient_parser")
def q_orient_parser(spark: SparkSession, sf: str) -> DataFrame:
    return ori.orient_parser(packets(spark, sf)).select("frame_number", "is_src_client")


@query("flow_table")
def q_flow_table(spark: SparkSession, sf: str) -> DataFrame:
    return ft.flow_table(packets(spark, sf))


@query("flow_sparkline")
def q_flow_sparkline(spark: SparkSession, sf: str) -> DataFrame:
    return ft.flow_sparklines(packets(spark, sf))


@query("flow_signals")
def q_flow_signals(spark: SparkSession, sf: str) -> DataFrame:
    return fl.flow_signals(packets(spark, sf)).select(
        *FLOW_KEY, "handshake_complete", "data_both", "rst_after_syn", "icmp_error", "first_syn_time",
        "first_rst_time")


@query("tls_outcome")
def q_tls_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return fl.tls_outcome(packets(spark, sf))


@query("flow_summary")
def q_flow_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ft.flow_summary(tag(rule_input(spark, sf), default_rules()))


@query("tag_flows_app")
def q_tag_flows_app(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.disposition import tag_flows
    return tag_flows(packets(spark, sf), with_app_fields=True)


@query("icmp_correlate")
def q_icmp_correlate(spark: SparkSession, sf: str) -> DataFrame:
    return icmp.icmp_error_counts(packets(spark, sf))


@query("tcp_heuristics")
def q_tcp_heuristics(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.tcp_heuristics(packets(spark, sf))


@query("packet_rtt")
def q_packet_rtt(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.packet_rtt(packets(spark, sf))


@query("handshake_rtt")
def q_handshake_rtt(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.handshake_rtt(packets(spark, sf))


@query("tls_time_to_alert")
def q_tls_time_to_alert(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.tls_time_to_alert(packets(spark, sf))


@query("rtt_samples")
def q_rtt_samples(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.rtt_samples(packets(spark, sf))

