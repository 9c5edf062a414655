"""P5: numeric protocol codes → names, as literal map lookups (``create_map``), unknown code →
its own text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import parse_int_text

# ---- Fixed values (must equal the reference's tables) ---------------------------------------
IP_PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP"}
IPV6_NEXT_HEADER_NAMES = {6: "TCP", 17: "UDP", 58: "ICMPv6", 47: "GRE", 50: "ESP"}
DNS_QUERY_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA",
                   33: "SRV", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 255: "ANY", 257: "CAA"}
DNS_RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
DHCP_MESSAGE_TYPES = {1: "Discover", 2: "Offer", 3: "Request", 4: "Decline", 5: "Ack", 6: "Nak",
                      7: "Release", 8: "Inform"}
TLS_HANDSHAKE_TYPES = {0: "HelloRequest", 1: "ClientHello", 2: "ServerHello", 4: "NewSessionTicket",
                       5: "EndOfEarlyData", 8: "EncryptedExtensions", 11: "Certificate",
                       12: "ServerKeyExchange", 13: "CertificateRequest", 14: "ServerHelloDone",
                       15: "CertificateVerify", 16: "ClientKeyExchange", 20: "Finished",
                       24: "CertificateStatus", 25: "KeyUpdate"}
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
TLS_ALERT_LEVELS = {1: "warning", 2: "fatal"}
TLS_ALERT_DESCRIPTIONS = {
    0: "close_notify", 10: "unexpected_message", 20: "bad_record_mac", 21: "decryption_failed_RESERVED",
    22: "record_overflow", 30: "decompression_failure", 40: "handshake_failure",
    41: "no_certificate_RESERVED", 42: "bad_certificate", 43: "unsupported_certificate",
    44: "certificate_revoked", 45: "certificate_expired", 46: "certificate_unknown",
    47: "illegal_parameter", 48: "unknown_ca", 49: "access_denied", 50: "decode_error",
    51: "decrypt_error", 60: "export_restriction_RESERVED", 70: "protocol_version",
    71: "insufficient_security", 80: "internal_error", 86: "inappropriate_fallback",
    90: "user_canceled", 100: "no_renegotiation_RESERVED", 110: "missing_extension",
    111: "unsupported_extension", 112: "unrecognized_name", 113: "bad_certificate_status_response",
    114: "unknown_psk_identity", 115: "certificate_required", 116: "no_application_protocol"}
# ---------------------------------------------------------------------------------------------


def lookup(code: Column, table: dict[int, str], text: bool = True) -> Column:
    """Name for a code; an unknown code yields its own text; null stays null. Text codes
    (``"0x0303"``, ``"1,234"``) are parsed first; pass ``text=False`` for integer columns."""
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    key = parse_int_text(code) if text else code.cast("long")
    return F.coalesce(m[key], code.cast("string"))


def ip_protocol_name(c: Column, ipv6: Column | None = None, text: bool = True) -> Column:
    """IPv4 protocol number, or IPv6 next header when ``ipv6`` is true."""
    v4 = lookup(c, IP_PROTOCOL_NAMES, text)
    if ipv6 is None:
        return v4
    return F.when(F.coalesce(ipv6, F.lit(False)), lookup(c, IPV6_NEXT_HEADER_NAMES, text)).otherwise(v4)


def dns_query_type_name(c: Column, text: bool = True) -> Column:
    return lookup(c, DNS_QUERY_TYPES, text)


def dns_rcode_name(c: Column, text: bool = True) -> Column:
    return lookup(c, DNS_RCODES, text)


def dhcp_message_type_name(c: Column, text: bool = True) -> Column:
    return lookup(c, DHCP_MESSAGE_TYPES, text)


def tls_handshake_type_name(c: Column, text: bool = True) -> Column:
    return lookup(c, TLS_HANDSHAKE_TYPES, text)


def tls_version_name(c: Column, text: bool = True) -> Column:
    return lookup(c, TLS_VERSIONS, text)


def tls_alert_level_name(c: Column, text: bool = True) -> Column:
    return lookup(c, TLS_ALERT_LEVELS, text)


def tls_alert_description_name(c: Column, text: bool = True) -> Column:
    return lookup(c, TLS_ALERT_DESCRIPTIONS, text)


def effective_tls_version(handshake_version: Column, record_version: Column) -> Column:
    """Handshake version when present (and non-empty), else the record version."""
    return F.coalesce(F.nullif(handshake_version, F.lit("")), record_version)


_DECODERS = {
    "ip_protocol": ("protocol", ip_protocol_name),
    "dns_query_type_code": ("dns_query_type", dns_query_type_name),
    "dns_rcode": ("dns_response_code", dns_rcode_name),
    "dhcp_message_type_code": ("dhcp_message_type", dhcp_message_type_name),
    "tls_handshake_type_code": ("tls_handshake_type", tls_handshake_type_name),
    "tls_handshake_version_code": ("tls_handshake_version", tls_version_name),
    "tls_record_version_code": ("tls_record_version", tls_version_name),
    "tls_alert_level_code": ("tls_alert_level", tls_alert_level_name),
    "tls_alert_description_code": ("tls_alert_message_description", tls_alert_description_name),
}


def decode_names(df: DataFrame) -> DataFrame:
    """Decode every ``*_code`` column present into its named column; add
    ``tls_effective_version`` when a version was decoded."""
    out = {}
    for code_col, (name_col, fn) in _DECODERS.items():
        if code_col in df.columns:
            is_text = isinstance(df.schema[code_col].dataType, T.StringType)
            out[name_col] = fn(F.col(code_col), text=is_text)
    df = df.withColumns(out) if out else df
    if "tls_handshake_version" in df.columns or "tls_record_version" in df.columns:
        hv = F.col("tls_handshake_version") if "tls_handshake_version" in df.columns else F.lit(None).cast("string")
        rv = F.col("tls_record_version") if "tls_record_version" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("tls_effective_version", effective_tls_version(hv, rv))
    return df
