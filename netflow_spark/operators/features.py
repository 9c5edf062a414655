"""G11 (extension): the per-flow fields the default rule pack asks for but no reference step
computes — handshake success, FIN from both sides, retransmission %, mean handshake RTT, TLS
success, initiator side, DNS response code name, first packet error — and the flow evidence that the
pack's error and security rules read. All come from the one shared aggregate over the packets
(``flows.flow_facts``), plus two small per-flow joins (W1 flags, W3 RTT means)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_not_null, with_oriented_key
from ..schema import FLOW_KEY
from .flows import flow_facts, signals_from_facts
from .ordered import handshake_rtt, retransmissions

RULE_FEATURES = ["tcp_handshake_successful", "tcp_fin_both_sides", "tcp_retransmission_rate_percent",
                 "flow_avg_rtt_ms", "tls_handshake_successful", "tcp_initiator", "dns_rcode_name",
                 "packet_error_reason"]


def rule_features(packets: DataFrame, keys: Sequence[str] = (), facts: DataFrame | None = None) -> DataFrame:
    keys = list(keys)
    group = [*keys, *FLOW_KEY]
    facts = facts if facts is not None else flow_facts(packets, keys)
    # Retransmissions per flow straight from W1 (oriented key carried through, no join by frame).
    heur = retransmissions(with_oriented_key(packets), keys, carry=FLOW_KEY)
    rt = heur.where(all_not_null(group)).groupBy(*group).agg(
        F.count_if(F.col("heuristic_retransmission")).alias("_rt"))
    rtt = handshake_rtt(packets, keys).groupBy(*group).agg(F.avg("rtt_ms").alias("flow_avg_rtt_ms"))
    signals = signals_from_facts(facts, keys, ["tcp_fin_both_sides", "_tcp", "tcp_initiator", "dns_rcode_name",
                                               "packet_error_reason"])
    out = signals.join(rtt, group, "left").join(rt, group, "left")
    pct = F.when(F.col("_tcp") > 0, F.coalesce(F.col("_rt"), F.lit(0)) * 100.0 / F.col("_tcp"))
    return out.select(*group, F.col("handshake_complete").alias("tcp_handshake_successful"), "tcp_fin_both_sides",
                      pct.alias("tcp_retransmission_rate_percent"), "flow_avg_rtt_ms",
                      F.col("tls_handshake_ok").alias("tls_handshake_successful"),
                      "tcp_initiator", "dns_rcode_name", "packet_error_reason")


def flow_evidence(packets: DataFrame, keys: Sequence[str] = (), facts: DataFrame | None = None) -> DataFrame:
    """One row per complete oriented flow with the fields the rule pack's error and security rules
    read, filled from the flow's packets: any RST, the first fatal alert, the first ICMP error, the
    sender of the first RST or ICMP error, the first HTTP method and TLS version, any self-signed
    certificate. ``flow_id`` is the key as text."""
    keys = list(keys)
    facts = facts if facts is not None else flow_facts(packets, keys)
    f = facts.where(all_not_null([*keys, *FLOW_KEY]))
    return f.select(
        *keys, *FLOW_KEY, F.concat_ws("|", *FLOW_KEY).alias("flow_id"),
        F.coalesce("_error_source", "client_ip").alias("source_ip"), F.col("server_ip").alias("destination_ip"),
        F.col("client_port").alias("source_port"), F.col("server_port").alias("destination_port"),
        F.col("_any_rst").alias("tcp_flags_rst"), F.col("_fatal.level").alias("tls_alert_level"),
        F.col("_fatal.alert").alias("tls_alert_message_description"), F.col("_icmp.type").alias("icmp_type"),
        F.col("_icmp.code").alias("icmp_code"), F.col("_method").alias("http_request_method"),
        F.col("_tls_version").alias("tls_effective_version"), F.col("_self_signed").alias("tls_cert_is_self_signed"),
        (F.col("bytes_c2s") + F.col("bytes_s2c")).alias("bytes_total"))


def tagged_flows(packets: DataFrame, rules=None, keys: Sequence[str] = (), facts: DataFrame | None = None) -> DataFrame:
    """Flows tagged by the rule pack on their evidence (one row per flow; input of A9–A13)."""
    from ..rules import default_rules, tag
    return tag(flow_evidence(packets, keys, facts), rules or default_rules())
