"""Per-row classifications as native ``when`` chains and literal map lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import first_present, flag, opt

# ---- Fixed values ---------------------------------------------------------------------------
# (L4 protocol, port) → application protocol, for the L7 guess.
L7_WELL_KNOWN_PORTS = {
    ("TCP", 20): "FTP", ("TCP", 21): "FTP", ("TCP", 22): "SSH", ("TCP", 23): "Telnet",
    ("TCP", 25): "SMTP", ("TCP", 53): "DNS", ("UDP", 53): "DNS", ("TCP", 80): "HTTP",
    ("TCP", 110): "POP3", ("TCP", 143): "IMAP", ("TCP", 443): "HTTPS/TLS",
}
QUIC_FIRST_FLIGHT_MIN_BYTES = 1200
# (L4 protocol, port) → service label, for the service guess.
SERVICE_PORTS = {
    ("TCP", 80): "HTTP", ("TCP", 443): "HTTPS", ("TCP", 22): "SSH", ("TCP", 993): "IMAPS",
    ("TCP", 465): "SMTPS", ("UDP", 53): "DNS",
}
RETRANS_SEVERITY = [(1.0, "Healthy", "#28a745"), (3.0, "Warning", "#ffc107"), (None, "Critical", "#dc3545")]
# ---------------------------------------------------------------------------------------------


def _pair_map(table: dict[tuple[str, int], str]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(f"{p}/{n}"), F.lit(v)) for (p, n), v in table.items()))


def packet_error_reason(df: DataFrame) -> Column:
    """ICMP 3/{0..3} → unreachable, ICMP 11 → time exceeded, TCP RST, else no error."""
    proto = F.upper(F.coalesce(F.col("protocol"), F.lit("")))
    t = opt(df, "icmp_type", "long").try_cast("double").try_cast("long")
    code = opt(df, "icmp_code", "long").try_cast("double").try_cast("long")
    icmp = proto == "ICMP"
    return (F.when(icmp & (t == 3) & code.isin(0, 1, 2, 3), F.lit("ICMP_Destination_Unreachable"))
            .when(icmp & (t == 11), F.lit("ICMP_Time_Exceeded"))
            .when((proto == "TCP") & flag(df, "tcp_flags_rst"), F.lit("TCP_RST_Received"))
            .otherwise(F.lit("no_error_detected")))


def path_mtu(df: DataFrame) -> Column:
    """ICMPv4 3/4 → ``icmp_mtu`` else ``icmp_nexthop_mtu``; ICMPv6 2/0 → ``icmp_mtu``."""
    t, c = opt(df, "icmp_type", "long"), opt(df, "icmp_code", "long")
    mtu, nh = opt(df, "icmp_mtu", "long"), opt(df, "icmp_nexthop_mtu", "long")
    proto = F.col("protocol")
    return (F.when((proto == "ICMP") & (t == 3) & (c == 4), F.coalesce(mtu, nh))
            .when((proto == "ICMPv6") & (t == 2) & (c == 0), mtu))


def guess_l7(df: DataFrame, protocol: str = "protocol") -> Column:
    """Best-guess application protocol from L4 protocol, ports and first-flight size."""
    proto = F.upper(F.coalesce(F.col(protocol).cast("string"), F.lit("")))
    dport = first_present(df, ["dest_port", "destination_port"], "long").try_cast("double").try_cast("long")
    sport = first_present(df, ["src_port", "source_port"], "long").try_cast("double").try_cast("long")
    first = F.coalesce(F.nullif(opt(df, "first_flight_bytes", "long"), F.lit(0)),
                       opt(df, "first_flight_packet_size", "long")).try_cast("double").try_cast("long")
    port = F.coalesce(dport, sport)
    known = _pair_map(L7_WELL_KNOWN_PORTS)[F.concat(proto, F.lit("/"), port.cast("string"))]
    quic = (proto == "UDP") & (F.coalesce(dport == 443, F.lit(False)) | F.coalesce(sport == 443, F.lit(False)))
    return (F.when(quic, F.when(F.coalesce(first > QUIC_FIRST_FLIGHT_MIN_BYTES, F.lit(False)), F.lit("QUIC"))
                   .otherwise(F.lit("QUIC_UDP_443")))
            .when(known.isNotNull(), known)
            .when(proto != "", proto)
            .otherwise(F.lit("Unknown_L7")))


def guess_service(protocol: Column, port: Column, sni: Column | None = None, http_host: Column | None = None,
                  rdns: Column | None = None, is_quic: Column | None = None) -> Column:
    """P10: sni → http host → QUIC on 443 → port table → first rDNS label → ``PROTO/port``."""
    none = F.lit(None).cast("string")
    sni = F.nullif(sni, F.lit("")) if sni is not None else none
    host = F.nullif(http_host, F.lit("")) if http_host is not None else none
    quic = F.coalesce(is_quic.cast("boolean"), F.lit(False)) if is_quic is not None else F.lit(False)
    p = F.upper(F.nullif(protocol.cast("string"), F.lit("")))
    port = port.cast("long")
    known = _pair_map(SERVICE_PORTS)[F.concat(p, F.lit("/"), port.cast("string"))]
    label = F.nullif(F.split(rdns, r"\.")[0], F.lit("")) if rdns is not None else none
    return (F.when(sni.isNotNull(), sni)
            .when(host.isNotNull(), host)
            .when(quic & F.coalesce(port == 443, F.lit(False)), F.lit("QUIC"))
            .when(known.isNotNull(), known)
            .when(label.isNotNull(), label)
            .when(p.isNotNull() & port.isNotNull(), F.concat(p, F.lit("/"), port.cast("string")))
            .otherwise(F.lit("Unknown Service")))


def service_open(protocol: Column, port: Column, sni: Column, http_host: Column, is_quic: Column) -> Column:
    """P10's rows that neither SNI, host, QUIC nor the port table decide: those an rDNS name may label."""
    p = F.upper(F.nullif(protocol.cast("string"), F.lit("")))
    known = _pair_map(SERVICE_PORTS)[F.concat(p, F.lit("/"), port.cast("long").cast("string"))]
    quic = F.coalesce(is_quic.cast("boolean"), F.lit(False)) & F.coalesce(port.cast("long") == 443, F.lit(False))
    return F.nullif(sni, F.lit("")).isNull() & F.nullif(http_host, F.lit("")).isNull() & ~quic & known.isNull()


def retransmission_severity(ratio: Column) -> Column:
    """struct(status, color) — <1 Healthy, ≤3 Warning, else Critical."""
    (t1, s1, c1), (t2, s2, c2), (_, s3, c3) = RETRANS_SEVERITY
    status = F.when(ratio < t1, F.lit(s1)).when(ratio <= t2, F.lit(s2)).otherwise(F.lit(s3))
    color = F.when(ratio < t1, F.lit(c1)).when(ratio <= t2, F.lit(c2)).otherwise(F.lit(c3))
    return F.struct(status.alias("status"), color.alias("color"))


def is_plaintext_http(df: DataFrame) -> Column:
    """Protocol HTTP, or TCP to port 80 carrying an HTTP method."""
    proto = F.upper(F.coalesce(first_present(df, ["protocol", "proto"]), F.lit("")))
    method = F.coalesce(F.nullif(first_present(df, ["http_request_method", "http_method"]), F.lit("")), F.lit(""))
    port = first_present(df, ["destination_port", "dest_port"], "long").try_cast("double").try_cast("long")
    return (proto == "HTTP") | ((proto == "TCP") & F.coalesce(port == 80, F.lit(False)) & (method != ""))


def tcp_analysis_flags(df: DataFrame, prefix: str = "tcp_analysis_") -> DataFrame:
    """Dissector indicator columns (booleans named ``{prefix}<indicator>``) → four token
    arrays; fast retransmission implies ``dup_ack_num`` = 3 unless given; a zero-window probe
    (or probe ack) implies ``zero_window``."""
    def ind(name):
        return flag(df, prefix + name)

    def tok(name, cond=None):
        return F.when(cond if cond is not None else ind(name), F.lit(name))
    dup_num = opt(df, prefix + "duplicate_ack_num", "long")
    zw_any = ind("zero_window") | ind("zero_window_probe") | ind("zero_window_probe_ack")
    retrans = F.array_compact(F.array(tok("retransmission"), tok("fast_retransmission"),
                                      tok("spurious_retransmission")))
    dup = F.array_compact(F.array(tok("duplicate_ack"),
                                  F.when(dup_num.isNotNull(),
                                         F.concat(F.lit("duplicate_ack_num:"), dup_num.cast("string")))))
    ooo = F.array_compact(F.array(tok("out_of_order"), tok("lost_segment")))
    win = F.array_compact(F.array(tok("zero_window", zw_any), tok("zero_window_probe"),
                                  tok("zero_window_probe_ack"), tok("window_update")))
    dup_ack_num = F.coalesce(dup_num, F.when(ind("fast_retransmission"), F.lit(3).cast("long")),
                             opt(df, "dup_ack_num", "long"))
    return df.withColumns({"tcp_analysis_retransmission_flags": retrans,
                           "tcp_analysis_duplicate_ack_flags": dup,
                           "tcp_analysis_out_of_order_flags": ooo,
                           "tcp_analysis_window_flags": win,
                           "dup_ack_num": dup_ack_num})


def dns_answers(c: Column, is_array: bool = False) -> Column:
    """Answers as ``array<string>`` — arrays pass through, text is split on commas and
    trimmed, empty items dropped; null → empty array."""
    arr = c.cast("array<string>") if is_array else F.split(c.cast("string"), ",")
    return F.filter(F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda x: F.trim(x)),
                    lambda x: x != "")


def split_port_key(c: Column) -> Column:
    """``tcp_443`` → struct(protocol ``TCP``, port 443)."""
    parts = F.split(c, "_", 2)
    return F.struct(F.upper(parts[0]).alias("protocol"), parts[1].try_cast("long").alias("port"))


def sparkline_stats(c: Column) -> Column:
    """struct(min, max, mean) of a comma-joined integer sparkline; null for ""/null."""
    vals = F.transform(F.split(c, ","), lambda x: x.try_cast("long"))
    ok = c.isNotNull() & (c != "")
    n = F.size(vals)
    total = F.aggregate(vals, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return F.when(ok, F.struct(F.array_min(vals).alias("min"), F.array_max(vals).alias("max"),
                               (total / n).alias("mean")))


def is_quic(df: DataFrame) -> Column:
    """UDP to port 443 → whether a QUIC layer was dissected (``quic_layer``); else null."""
    udp443 = (F.col("protocol") == "UDP") & (opt(df, "destination_port", "long") == 443)
    return F.when(udp443, flag(df, "quic_layer"))
