"""Per-flow aggregates over oriented packets.

Everything that the reference computes with nine separate group-bys plus re-index/merge
(handshake, data both ways, RST after SYN, ICMP error, TLS handshake outcome) is one
``groupBy(oriented 5-tuple).agg(...)`` here: a single shuffle with map-side partial
aggregation, so an elephant flow is pre-reduced in every map task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import packet_error_reason
from ..functions.columns import (all_not_null, bool_any, direction, first_present, flag, is_client, is_server,
                                 min_when, opt, with_oriented_key)
from ..schema import FLOW_KEY

# Fixed values of the reference's heuristics.
RST_AFTER_SYN_MAX_SECONDS = 2
TLS_SERVER_HELLO_MAX_SECONDS = 5
ICMP_PROTOCOLS = ["ICMP", "ICMPV6"]
ICMP_ERROR_TYPES = [3, 11]


def oriented(packets: DataFrame) -> DataFrame:
    return with_oriented_key(packets)


def _signal_aggs(df: DataFrame) -> list[Column]:
    c, s = is_client(df), is_server(df)
    syn, ack, psh, rst = (flag(df, f"tcp_flags_{n}") for n in ("syn", "ack", "psh", "rst"))
    ts = F.col("timestamp")
    hs = opt(df, "tls_handshake_type")
    alert = opt(df, "tls_alert_message_description").isNotNull() | rst
    icmp = F.upper(F.col("protocol")).isin(ICMP_PROTOCOLS) & opt(df, "icmp_type", "long").isin(ICMP_ERROR_TYPES)
    return [
        min_when(c & syn & ~ack, ts).alias("first_syn_time"),
        bool_any(s & syn & ack).alias("_synack"),
        bool_any(c & ack & ~syn).alias("_ack"),
        bool_any(c & psh).alias("_data_c"),
        bool_any(s & psh).alias("_data_s"),
        min_when(s & rst, ts).alias("first_rst_time"),
        bool_any(icmp).alias("icmp_error"),
        min_when(c & (hs == "ClientHello"), ts).alias("first_client_hello_time"),
        min_when(s & (hs == "ServerHello"), ts).alias("first_server_hello_time"),
        min_when(alert, ts).alias("first_alert_time"),
    ]


def _table_aggs(df: DataFrame) -> list[Column]:
    """Flow-table sums (null length → 0, null time → 0.0) in the same aggregate as the signals."""
    c2s = F.coalesce(F.col("is_source_client"), F.lit(False))
    ln = F.coalesce(opt(df, "packet_length", "long").try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    ts = opt(df, "timestamp", "double").cast("double")  # packets without one count, but set no time
    return [F.sum(F.when(c2s, ln).otherwise(0)).alias("bytes_c2s"),
            F.sum(F.when(~c2s, ln).otherwise(0)).alias("bytes_s2c"),
            F.sum(F.when(c2s, 1).otherwise(0)).cast("long").alias("pkts_c2s"),
            F.sum(F.when(~c2s, 1).otherwise(0)).cast("long").alias("pkts_s2c"),
            F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts")]


def _evidence_aggs(df: DataFrame) -> list[Column]:
    """What single packets of the flow show, in the same aggregate: rule features (G11), the HTTP
    407 evidence (R2) and the evidence of the rule pack's error and security rules (A9–A13)."""
    c, s, frame = is_client(df), is_server(df), opt(df, "frame_number", "long")
    syn0 = flag(df, "tcp_flags_syn") & ~flag(df, "tcp_flags_ack")
    rst, fin = flag(df, "tcp_flags_rst"), flag(df, "tcp_flags_fin")
    rc, reason = opt(df, "dns_response_code"), F.col("_reason")
    level, alert = opt(df, "tls_alert_level"), opt(df, "tls_alert_message_description")
    kind, code = opt(df, "icmp_type", "long"), opt(df, "icmp_code", "long")
    fatal = F.coalesce((level == "fatal") & alert.isNotNull(), F.lit(False))
    icmp_error = F.coalesce(F.upper(F.col("protocol")).isin(ICMP_PROTOCOLS) & kind.isin(ICMP_ERROR_TYPES), F.lit(False))

    def first(value: Column, when: Column) -> Column:
        return F.min_by(value, F.when(when, frame))

    return [
        (bool_any(c & fin) & bool_any(s & fin)).alias("tcp_fin_both_sides"),
        F.count_if(F.upper(F.col("protocol")) == "TCP").alias("_tcp"),
        first(F.when(c, F.lit("client")).when(s, F.lit("server")), syn0 & (c | s)).alias("tcp_initiator"),
        first(rc, rc.isNotNull()).alias("dns_rcode_name"),
        F.coalesce(first(reason, reason != "no_error_detected"), F.lit("no_error_detected")).alias("packet_error_reason"),
        bool_any(first_present(df, ["http_status", "http_response_code"], "long") == 407).alias("_any_407"),
        bool_any(rst).alias("_any_rst"),
        first(F.struct(level.alias("level"), alert.alias("alert")), fatal).alias("_fatal"),
        first(F.struct(kind.alias("type"), code.alias("code")), icmp_error).alias("_icmp"),
        first(F.col("source_ip"), rst | icmp_error).alias("_error_source"),
        first(opt(df, "http_request_method"), opt(df, "http_request_method").isNotNull()).alias("_method"),
        first(opt(df, "tls_effective_version"), opt(df, "tls_effective_version").isNotNull()).alias("_tls_version"),
        bool_any(flag(df, "tls_cert_is_self_signed")).alias("_self_signed"),
    ]


def flow_facts(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One aggregate per raw oriented 5-tuple (null parts kept as their own groups) carrying
    everything the signals (G7), TLS outcome (G9), flow table (G5), rule features (G11) and flow
    evidence need — one shuffle of the packets for all of them. Unused aggregates are pruned by Catalyst when a caller needs less."""
    df = oriented(packets)
    df = df.withColumn("is_source_client", direction(df)).withColumn("_reason", packet_error_reason(df))
    return df.groupBy(*keys, *FLOW_KEY).agg(*_signal_aggs(df), *_table_aggs(df), *_evidence_aggs(df))


def signals_from_facts(facts: DataFrame, keys: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """G7 + G9 from flow facts: complete keys only (the reference's group-by drops null keys).
    ``extra`` facts are passed through."""
    group = [*keys, *FLOW_KEY]
    agg = facts.where(all_not_null(group))
    syn, sh, ch, alert, rst = (F.col(n) for n in ("first_syn_time", "first_server_hello_time",
                                                  "first_client_hello_time", "first_alert_time",
                                                  "first_rst_time"))
    tls_ok = (sh.isNotNull() & (alert.isNull() | (sh <= alert))
              & ((sh - ch) <= TLS_SERVER_HELLO_MAX_SECONDS))
    return agg.select(
        *group,
        (syn.isNotNull() & F.col("_synack") & F.col("_ack")).alias("handshake_complete"),
        (F.col("_data_c") & F.col("_data_s")).alias("data_both"),
        F.coalesce((rst - syn) <= RST_AFTER_SYN_MAX_SECONDS, F.lit(False)).alias("rst_after_syn"),
        F.col("icmp_error"),
        syn.alias("first_syn_time"),
        rst.alias("first_rst_time"),
        ch.alias("first_client_hello_time"),
        sh.alias("first_server_hello_time"),
        F.when(ch.isNotNull(), tls_ok).alias("tls_handshake_ok"),
        alert.alias("first_alert_time"),
        (alert - ch).alias("time_to_alert"),
        *extra,
    )


def flow_signals(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G7 + G9: one row per oriented flow with handshake/data/RST/ICMP/TLS signals.

    Rows whose oriented key has a null part are dropped (the reference's group-by does that).
    """
    return signals_from_facts(flow_facts(packets, keys), keys)


def tls_outcome(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G9 on its own: TLS handshake outcome per oriented flow."""
    return flow_signals(packets, keys).select(
        *keys, *FLOW_KEY, "first_client_hello_time", "first_server_hello_time", "tls_handshake_ok",
        "first_alert_time", "time_to_alert")
