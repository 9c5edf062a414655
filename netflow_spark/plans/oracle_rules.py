"""Hand-written DuckDB oracles for the rule queries (a CASE per target, written from the rule
semantics, not generated by the compiler)."""

from __future__ import annotations

from .oracle import oracle

_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def v4(col: str) -> str:
    """DuckDB expression: dotted quad → BIGINT, NULL when invalid."""
    pat = rf"^{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}$"
    return (f"(CASE WHEN regexp_full_match(coalesce({col}, ''), '{pat}') THEN "
            f"CAST(split_part({col}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({col}, '.', 2) AS BIGINT) * 65536 "
            f"+ CAST(split_part({col}, '.', 3) AS BIGINT) * 256 + CAST(split_part({col}, '.', 4) AS BIGINT) END)")


def in_net(col: str, a: int, b: int, c: int, d: int, bits: int) -> str:
    lo = ((a << 24) | (b << 16) | (c << 8) | d) & (((1 << 32) - 1) ^ ((1 << (32 - bits)) - 1))
    hi = lo + (1 << (32 - bits)) - 1
    return f"coalesce({v4(col)} BETWEEN {lo} AND {hi}, false)"


def _q(table: str, idc: str, case: str) -> str:
    return f"SELECT {idc}, {case} AS result FROM {table}"


oracle("rules_equals", _q("orders", "o_orderkey", """CASE
  WHEN o_orderpriority = '1-URGENT' THEN 'URGENT'
  WHEN o_custkey = 7 THEN 'CUST7'
  WHEN o_orderstatus = 'F' THEN 'FILLED'
  ELSE 'DEFAULT' END"""), packets=False)

oracle("rules_not_equals", _q("packets", "frame_number", """CASE
  WHEN sni IS DISTINCT FROM 'host1.example.com' THEN 'NOT_HOST1'
  WHEN protocol IS DISTINCT FROM 'TCP' THEN 'NOT_TCP'
  ELSE 'DEFAULT' END"""))

oracle("rules_in", _q("packets", "frame_number", """CASE
  WHEN protocol = 'UDP' THEN 'UDP'
  WHEN dns_response_code IN ('NXDOMAIN', 'SERVFAIL') THEN 'DNSERR'
  WHEN destination_port IN (80, 443) THEN 'WEB'
  ELSE 'DEFAULT' END"""))

oracle("rules_not_in", _q("packets", "frame_number", """CASE
  WHEN NOT coalesce(destination_port IN (80, 443), false) THEN 'NOT_WEB'
  WHEN NOT coalesce(sni IN ('host1.example.com', 'host2.example.com'), false) THEN 'OTHER_SNI'
  ELSE 'DEFAULT' END"""))

oracle("rules_regex", _q("customer", "c_custkey", """CASE
  WHEN coalesce(regexp_matches(c_mktsegment, '^MACH|^AUTO'), false) THEN 'SEG'
  WHEN coalesce(regexp_matches(c_name, 'CUSTOMER#00000001', 'i'), false) THEN 'MATCH'
  ELSE 'DEFAULT' END"""), packets=False)

oracle("rules_not_regex", _q("packets", "frame_number", """CASE
  WHEN NOT coalesce(regexp_matches(sni, 'host1\\d\\.'), false) THEN 'NOMATCH'
  ELSE 'DEFAULT' END"""))

oracle("rules_cidr", _q("packets", "frame_number", f"""CASE
  WHEN {in_net('destination_ip', 203, 0, 113, 0, 28)} THEN 'DST_NET'
  WHEN {in_net('source_ip', 10, 1, 0, 0, 25)} THEN 'LOCAL_LOW'
  ELSE 'DEFAULT' END"""))

oracle("rules_not_cidr", _q("packets", "frame_number", f"""CASE
  WHEN NOT {in_net('destination_ip', 203, 0, 113, 0, 24)} THEN 'NOT_DOC_NET'
  ELSE 'DEFAULT' END"""))

oracle("rules_gt", _q("orders", "o_orderkey", """CASE
  WHEN o_totalprice > 300000 THEN 'BIG' ELSE 'DEFAULT' END"""), packets=False)

oracle("rules_lt", _q("orders", "o_orderkey", """CASE
  WHEN o_custkey < 10 THEN 'LOWKEY'
  WHEN o_totalprice < 50000.5 THEN 'SMALL' ELSE 'DEFAULT' END"""), packets=False)

oracle("rules_gte", _q("packets", "frame_number", """CASE
  WHEN packet_length >= 500 THEN 'LARGE' ELSE 'DEFAULT' END"""))

oracle("rules_lte", _q("packets", "frame_number", """CASE
  WHEN tcp_flags_syn IS TRUE THEN 'SYN'
  WHEN packet_length <= 45 THEN 'TINY' ELSE 'DEFAULT' END"""))

oracle("rules_exists", _q("packets", "frame_number", """CASE
  WHEN sni IS NOT NULL THEN 'HAS_SNI' ELSE 'DEFAULT' END"""))

oracle("rules_not_exists", _q("packets", "frame_number", """CASE
  WHEN http_request_method IS NULL THEN 'NO_METHOD' ELSE 'DEFAULT' END"""))

oracle("rules_starts_with", _q("packets", "frame_number", """CASE
  WHEN starts_with(CAST(destination_port AS VARCHAR), '44') THEN 'PORT44'
  WHEN coalesce(starts_with(dns_query_name, 'host1'), false) THEN 'HOST1'
  ELSE 'DEFAULT' END"""))

oracle("rules_ends_with", _q("packets", "frame_number", """CASE
  WHEN is_source_client IS TRUE THEN 'CLIENT'
  WHEN coalesce(ends_with(sni, '3.example.com'), false) THEN 'SNI3'
  ELSE 'DEFAULT' END"""))

oracle("rules_conditions", _q("packets", "frame_number", """CASE
  WHEN sni IS NOT NULL OR http_request_method IS NOT NULL THEN 'APP'
  WHEN protocol = 'TCP' AND (destination_port = 443 OR source_port = 443) THEN 'TLS_PORT'
  ELSE 'ALL' END"""))

oracle("rules_unknown", _q("packets", "frame_number", """CASE
  WHEN protocol = 'UDP' THEN 'UDP' ELSE 'DEFAULT' END"""))

oracle("rules_stop", _q("packets", "frame_number", """CASE
  WHEN tcp_flags_syn IS TRUE THEN (CASE WHEN protocol = 'TCP' THEN 'TCP' ELSE 'DEFAULT' END)
  WHEN protocol = 'UDP' THEN 'UDP'
  WHEN sni IS NOT NULL THEN 'SNI'
  WHEN destination_port = 443 THEN 'HTTPS'
  WHEN protocol = 'TCP' THEN 'TCP'
  ELSE 'DEFAULT' END"""))

oracle("rules_format", _q("packets", "frame_number", """CASE
  WHEN http_request_method IS NOT NULL THEN 'client=' ||
       CASE WHEN is_source_client THEN 'True' WHEN NOT is_source_client THEN 'False' ELSE '' END
       || ' m=' || http_request_method
  WHEN dns_query_name IS NOT NULL THEN 'plain'
  WHEN protocol = 'UDP' THEN '{protocol}-{nope}'
  WHEN destination_port = 443 THEN coalesce(protocol, '') || ':' || CAST(destination_port AS VARCHAR)
       || ' sni=' || coalesce(sni, '')
  ELSE 'DEFAULT' END"""))

oracle("rules_defaults", """
SELECT frame_number,
  CASE WHEN protocol = 'UDP' THEN 'udp' END AS kind1,
  CASE WHEN protocol = 'UDP' THEN 'from_t1' ELSE 'base' END AS kind2,
  sni IS NOT NULL AS flag,
  'Analyzed' AS flow_outcome
FROM packets""")

oracle("rules_flow_outcome", """
SELECT frame_number, '' AS dummy,
  CASE WHEN dns_response_code = 'NXDOMAIN' THEN 'NX'
       WHEN protocol = 'TCP' THEN 'TCP'
       ELSE 'engine_error' END AS flow_outcome
FROM packets""")

# ---- default pack over packets + parser-derived columns ------------------------------------
_RI = f"""
ri AS (
  SELECT *,
    CASE WHEN source_ip IS NULL AND destination_ip IS NULL THEN NULL ELSE
      {in_net('source_ip', 104, 129, 192, 0, 20)} OR {in_net('source_ip', 165, 225, 0, 0, 17)}
      OR {in_net('destination_ip', 104, 129, 192, 0, 20)} OR {in_net('destination_ip', 165, 225, 0, 0, 17)} END AS is_zscaler_ip,
    CASE WHEN source_ip IS NULL AND destination_ip IS NULL THEN NULL ELSE
      {in_net('source_ip', 100, 64, 0, 0, 10)} OR {in_net('destination_ip', 100, 64, 0, 0, 10)} END AS is_zpa_synthetic_ip,
    string_split(dns_response_addresses_csv, ',') AS dns_response_addresses
  FROM packets)"""

DISPOSITION_CASE = """CASE
  WHEN tcp_flags_rst IS TRUE AND tcp_flags_ack IS TRUE THEN 'Blocked - Connection Refused (RST from Destination)'
  WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp_type = 3 AND icmp_code = 1 THEN
       'Network Error - Host Unreachable (' || protocol || ' Type:' || CAST(icmp_type AS VARCHAR) || '/Code:' || CAST(icmp_code AS VARCHAR) || ')'
  WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp_type = 3 AND icmp_code = 3 THEN
       'Network Error - Port Unreachable (' || protocol || ' Type:' || CAST(icmp_type AS VARCHAR) || '/Code:' || CAST(icmp_code AS VARCHAR) || ')'
  WHEN dns_response_code = 'NXDOMAIN' THEN 'DNS Error - Non-Existent Domain (' || coalesce(dns_query_name, '') || ')'
  WHEN dns_response_code = 'SERVFAIL' THEN 'DNS Error - Server Failure (' || coalesce(dns_query_name, '') || ')'
  WHEN http_response_code = 407 THEN 'Blocked - Proxy Authentication Failed'
  WHEN tcp_flags_rst IS TRUE AND is_zscaler_ip IS FALSE THEN 'Connection Reset (RST)'
  WHEN tcp_flags_syn IS TRUE AND tcp_flags_ack IS TRUE THEN 'Connection Progressing (SYN-ACK)'
  WHEN protocol = 'TCP' AND tls_handshake_type IN ('ServerHello', 'Finished') AND tls_alert_message_description IS NULL
       THEN 'Allowed - Likely (TLS Handshake OK)'
  WHEN dns_response_code = 'NOERROR' THEN 'DNS Resolution OK (' || coalesce(dns_query_name, '') || ' -> '
       || coalesce(array_to_string(dns_response_addresses, ','), '') || ')'
  ELSE 'Undetermined' END"""
TRAFFIC_TYPE_CASE = """CASE
  WHEN destination_port = 443 AND protocol = 'TCP' AND sni IS NOT NULL THEN 'HTTPS (TLS/SNI)'
  WHEN destination_port = 443 AND protocol = 'TCP' AND tls_handshake_type IS NOT NULL THEN 'HTTPS (TLS)'
  WHEN destination_port = 80 AND protocol = 'TCP' AND http_request_method IS NOT NULL THEN 'HTTP'
  WHEN destination_port = 53 AND protocol IN ('UDP', 'TCP') AND dns_query_name IS NOT NULL THEN 'DNS'
  WHEN destination_port = 22 AND protocol = 'TCP' THEN 'SSH'
  WHEN source_port = 20 AND protocol = 'TCP' THEN 'FTP-Data (Active)'
  WHEN protocol = 'ICMP' AND icmp_type = 8 AND icmp_code = 0 THEN 'ICMPv4 Echo Request'
  WHEN protocol = 'ICMP' AND icmp_type = 0 AND icmp_code = 0 THEN 'ICMPv4 Echo Reply'
  WHEN protocol = 'ICMPv6' AND icmp_type = 128 AND icmp_code = 0 THEN 'ICMPv6 Echo Request'
  WHEN protocol = 'ICMPv6' AND icmp_type = 129 AND icmp_code = 0 THEN 'ICMPv6 Echo Reply'
  WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp_type = 11 THEN protocol || ' Time Exceeded (Type:'
       || coalesce(CAST(icmp_type AS VARCHAR), '') || '/Code:' || coalesce(CAST(icmp_code AS VARCHAR), '') || ')'
  WHEN protocol IN ('ICMP', 'ICMPv6') THEN protocol || ' (Type:' || coalesce(CAST(icmp_type AS VARCHAR), '')
       || '/Code:' || coalesce(CAST(icmp_code AS VARCHAR), '') || ')'
  WHEN destination_port = 21 AND protocol = 'TCP' THEN 'FTP-Control'
  ELSE 'Unknown' END"""
OBSERVATION_CASE = """CASE
  WHEN tls_cert_is_self_signed IS TRUE THEN 'Potential Untrusted TLS Certificate'
  WHEN sni IS NOT NULL AND NOT coalesce(destination_port IN (443, 853, 993, 995, 465, 587), false)
       THEN 'TLS on Non-Standard Port (' || coalesce(CAST(destination_port AS VARCHAR), '') || ')'
  WHEN http_request_method = 'POST' AND destination_port = 80 THEN 'Sensitive Data Exposure Risk (HTTP POST)'
  WHEN tls_effective_version IN ('TLS 1.0', 'TLS 1.1') THEN 'Outdated TLS Version (' || tls_effective_version || ')'
  ELSE 'None' END"""
RULE_INPUT_CTE = _RI

oracle("rules_disposition", "WITH " + _RI + """
SELECT frame_number, CASE
  WHEN tcp_flags_rst IS TRUE AND tcp_flags_ack IS TRUE THEN 'Blocked - Connection Refused (RST from Destination)'
  WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp_type = 3 AND icmp_code = 1 THEN
       'Network Error - Host Unreachable (' || protocol || ' Type:' || CAST(icmp_type AS VARCHAR) || '/Code:' || CAST(icmp_code AS VARCHAR) || ')'
  WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp_type = 3 AND icmp_code = 3 THEN
       'Network Error - Port Unreachable (' || protocol || ' Type:' || CAST(icmp_type AS VARCHAR) || '/Code:' || CAST(icmp_code AS VARCHAR) || ')'
  WHEN dns_response_code = 'NXDOMAIN' THEN 'DNS Error - Non-Existent Domain (' || coalesce(dns_query_name, '') || ')'
  WHEN dns_response_code = 'SERVFAIL' THEN 'DNS Error - Server Failure (' || coalesce(dns_query_name, '') || ')'
  WHEN http_response_code = 407 THEN 'Blocked - Proxy Authentication Failed'
  WHEN tcp_flags_rst IS TRUE AND is_zscaler_ip IS FALSE THEN 'Connection Reset (RST)'
  WHEN tcp_flags_syn IS TRUE AND tcp_flags_ack IS TRUE THEN 'Connection Progressing (SYN-ACK)'
  WHEN protocol = 'TCP' AND tls_handshake_type IN ('ServerHello', 'Finished') AND tls_alert_message_description IS NULL
       THEN 'Allowed - Likely (TLS Handshake OK)'
  WHEN dns_response_code = 'NOERROR' THEN 'DNS Resolution OK (' || coalesce(dns_query_name, '') || ' -> '
       || coalesce(array_to_string(dns_response_addresses, ','), '') || ')'
  ELSE 'Undetermined' END AS flow_disposition
FROM ri""")

oracle("rules_traffic_type", "WITH " + _RI + """
SELECT frame_number, CASE
  WHEN destination_port = 443 AND protocol = 'TCP' AND sni IS NOT NULL THEN 'HTTPS (TLS/SNI)'
  WHEN destination_port = 443 AND protocol = 'TCP' AND tls_handshake_type IS NOT NULL THEN 'HTTPS (TLS)'
  WHEN destination_port = 80 AND protocol = 'TCP' AND http_request_method IS NOT NULL THEN 'HTTP'
  WHEN destination_port = 53 AND protocol IN ('UDP', 'TCP') AND dns_query_name IS NOT NULL THEN 'DNS'
  WHEN destination_port = 22 AND protocol = 'TCP' THEN 'SSH'
  WHEN source_port = 20 AND protocol = 'TCP' THEN 'FTP-Data (Active)'
  WHEN protocol = 'ICMP' AND icmp_type = 8 AND icmp_code = 0 THEN 'ICMPv4 Echo Request'
  WHEN protocol = 'ICMP' AND icmp_type = 0 AND icmp_code = 0 THEN 'ICMPv4 Echo Reply'
  WHEN protocol = 'ICMPv6' AND icmp_type = 128 AND icmp_code = 0 THEN 'ICMPv6 Echo Request'
  WHEN protocol = 'ICMPv6' AND icmp_type = 129 AND icmp_code = 0 THEN 'ICMPv6 Echo Reply'
  WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp_type = 11 THEN protocol || ' Time Exceeded (Type:'
       || coalesce(CAST(icmp_type AS VARCHAR), '') || '/Code:' || coalesce(CAST(icmp_code AS VARCHAR), '') || ')'
  WHEN protocol IN ('ICMP', 'ICMPv6') THEN protocol || ' (Type:' || coalesce(CAST(icmp_type AS VARCHAR), '')
       || '/Code:' || coalesce(CAST(icmp_code AS VARCHAR), '') || ')'
  WHEN destination_port = 21 AND protocol = 'TCP' THEN 'FTP-Control'
  ELSE 'Unknown' END AS traffic_type_guess
FROM ri""")

oracle("rules_observation", "WITH " + _RI + """
SELECT frame_number, CASE
  WHEN tls_cert_is_self_signed IS TRUE THEN 'Potential Untrusted TLS Certificate'
  WHEN sni IS NOT NULL AND NOT coalesce(destination_port IN (443, 853, 993, 995, 465, 587), false)
       THEN 'TLS on Non-Standard Port (' || coalesce(CAST(destination_port AS VARCHAR), '') || ')'
  WHEN http_request_method = 'POST' AND destination_port = 80 THEN 'Sensitive Data Exposure Risk (HTTP POST)'
  WHEN tls_effective_version IN ('TLS 1.0', 'TLS 1.1') THEN 'Outdated TLS Version (' || tls_effective_version || ')'
  ELSE 'None' END AS security_observation
FROM ri""")

oracle("rules_vendor", "WITH " + _RI + """
SELECT frame_number, CASE
  WHEN is_zpa_synthetic_ip IS TRUE THEN 'ZPA Synthetic IP Communication'
  WHEN is_zscaler_ip IS TRUE AND is_zpa_synthetic_ip IS FALSE THEN 'Interacting with Zscaler Cloud IP'
  ELSE 'N/A' END AS zscaler_specific_finding
FROM ri""")

oracle("rules_errors", "WITH " + _RI + """
SELECT frame_number,
  CASE WHEN protocol = 'TCP' AND tcp_flags_rst IS TRUE THEN 'TCP_RESET'
       WHEN tls_alert_level = 'fatal' AND tls_alert_message_description IS NOT NULL
            THEN 'TLS_FATAL_' || tls_alert_message_description
       WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp_type = 3 AND icmp_code = 1 THEN 'ICMP_DEST_UNREACHABLE_HOST'
  END AS flow_error_type,
  CASE WHEN protocol = 'TCP' AND tcp_flags_rst IS TRUE THEN 'Source: ' || coalesce(source_ip, '')
       WHEN tls_alert_level = 'fatal' AND tls_alert_message_description IS NOT NULL THEN tls_alert_message_description
       WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp_type = 3 AND icmp_code = 1 THEN 'Source: ' || coalesce(source_ip, '')
  END AS flow_error_details
FROM ri""")

oracle("rules_flags", "WITH " + _RI + """
SELECT frame_number,
  (destination_port = 80 AND http_request_method IS NOT NULL) IS TRUE AS security_flag_plaintext_http,
  CASE WHEN tls_effective_version = 'TLS 1.1' THEN tls_effective_version
       WHEN tls_effective_version = 'TLS 1.0' THEN tls_effective_version END AS security_flag_outdated_tls_version,
  tls_cert_is_self_signed IS TRUE AS security_flag_self_signed_cert
FROM ri""")
