"""DuckDB oracles for projections, aggregations, top-k, enrichment and interval joins."""

from __future__ import annotations

from .oracle import _SIGNALS, RAW, nested, oracle
from .oracle_flows import _FLOW_KEY
from .oracle_rules import in_net, v4

_COMMON = "('US', 'CA', 'GB', 'DE', 'FR', 'NL', 'JP', 'AU')"


# Fixed values, written out so that the oracle does not share the Spark side's tables: code=name.
IP_PROTOCOL_NAMES = """
1=ICMP, 6=TCP, 17=UDP, 47=GRE, 50=ESP
"""
DNS_QUERY_TYPES = """
1=A, 2=NS, 5=CNAME, 6=SOA, 12=PTR, 15=MX, 16=TXT, 28=AAAA, 33=SRV, 43=DS, 46=RRSIG, 47=NSEC,
48=DNSKEY, 255=ANY, 257=CAA
"""
DNS_RCODES = """
0=NOERROR, 1=FORMERR, 2=SERVFAIL, 3=NXDOMAIN, 4=NOTIMP, 5=REFUSED
"""
DHCP_MESSAGE_TYPES = """
1=Discover, 2=Offer, 3=Request, 4=Decline, 5=Ack, 6=Nak, 7=Release, 8=Inform
"""
TLS_HANDSHAKE_TYPES = """
0=HelloRequest, 1=ClientHello, 2=ServerHello, 4=NewSessionTicket, 5=EndOfEarlyData,
8=EncryptedExtensions, 11=Certificate, 12=ServerKeyExchange, 13=CertificateRequest,
14=ServerHelloDone, 15=CertificateVerify, 16=ClientKeyExchange, 20=Finished, 24=CertificateStatus,
25=KeyUpdate
"""
TLS_VERSIONS = """
768=SSL 3.0, 769=TLS 1.0, 770=TLS 1.1, 771=TLS 1.2, 772=TLS 1.3
"""
TLS_ALERT_LEVELS = """
1=warning, 2=fatal
"""
TLS_ALERT_DESCRIPTIONS = """
0=close_notify, 10=unexpected_message, 20=bad_record_mac, 21=decryption_failed_RESERVED,
22=record_overflow, 30=decompression_failure, 40=handshake_failure, 41=no_certificate_RESERVED,
42=bad_certificate, 43=unsupported_certificate, 44=certificate_revoked, 45=certificate_expired,
46=certificate_unknown, 47=illegal_parameter, 48=unknown_ca, 49=access_denied, 50=decode_error,
51=decrypt_error, 60=export_restriction_RESERVED, 70=protocol_version, 71=insufficient_security,
80=internal_error, 86=inappropriate_fallback, 90=user_canceled, 100=no_renegotiation_RESERVED,
110=missing_extension, 111=unsupported_extension, 112=unrecognized_name,
113=bad_certificate_status_response, 114=unknown_psk_identity, 115=certificate_required,
116=no_application_protocol
"""


def _case(col: str, table: str) -> str:
    pairs = [p.strip().split("=") for p in table.replace("\n", " ").split(",")]
    whens = " ".join(f"WHEN {k.strip()} THEN '{v.strip()}'" for k, v in pairs)
    return f"CASE {col} {whens} ELSE CAST({col} AS VARCHAR) END"


# ---- projections -------------------------------------------------------------------------------
oracle("fill_ints", """
SELECT frame_number, coalesce(source_port, -1) AS source_port, coalesce(destination_port, -1) AS destination_port,
  coalesce(packet_length, 0) AS packet_length, coalesce(tcp_sequence_number, -1) AS tcp_sequence_number,
  coalesce(tcp_acknowledgment_number, -1) AS tcp_acknowledgment_number, coalesce(tcp_window_size, 0) AS tcp_window_size,
  coalesce(icmp_type, -1) AS icmp_type, coalesce(icmp_code, -1) AS icmp_code
FROM packets""")

oracle("decode_names", f"""
WITH c AS (
  SELECT event_id, event_id % 64 AS ip_protocol, event_id % 260 AS qt, user_id % 8 AS rc, user_id % 10 AS dh,
    event_id % 27 AS hs, CASE WHEN event_type NOT IN ('view', 'click') THEN 766 + event_id % 8 END AS hv,
    767 + user_id % 6 AS rv, user_id % 4 AS al, CAST(floor(value) AS BIGINT) % 120 AS ad
  FROM events),
n AS (
  SELECT event_id, {_case('ip_protocol', IP_PROTOCOL_NAMES)} AS protocol,
    {_case('qt', DNS_QUERY_TYPES)} AS dns_query_type, {_case('rc', DNS_RCODES)} AS dns_response_code,
    {_case('dh', DHCP_MESSAGE_TYPES)} AS dhcp_message_type, {_case('hs', TLS_HANDSHAKE_TYPES)} AS tls_handshake_type,
    {_case('hv', TLS_VERSIONS)} AS tls_handshake_version, {_case('rv', TLS_VERSIONS)} AS tls_record_version,
    {_case('al', TLS_ALERT_LEVELS)} AS tls_alert_level, {_case('ad', TLS_ALERT_DESCRIPTIONS)} AS tls_alert_message_description
  FROM c)
SELECT event_id, protocol, dns_query_type, dns_response_code, dhcp_message_type, tls_handshake_type,
  tls_handshake_version, tls_record_version, coalesce(nullif(tls_handshake_version, ''), tls_record_version) AS tls_effective_version,
  tls_alert_level, tls_alert_message_description
FROM n""", packets=False)

oracle("vendor_ip_flags", f"""
SELECT frame_number, source_ip, destination_ip,
  CASE WHEN source_ip IS NULL AND destination_ip IS NULL THEN NULL ELSE
    {in_net('source_ip', 104, 129, 192, 0, 20)} OR {in_net('source_ip', 165, 225, 0, 0, 17)}
    OR {in_net('destination_ip', 104, 129, 192, 0, 20)} OR {in_net('destination_ip', 165, 225, 0, 0, 17)} END AS is_zscaler_ip,
  CASE WHEN source_ip IS NULL AND destination_ip IS NULL THEN NULL ELSE
    {in_net('source_ip', 100, 64, 0, 0, 10)} OR {in_net('destination_ip', 100, 64, 0, 0, 10)} END AS is_zpa_synthetic_ip
FROM packets""")

_REASON = """CASE
  WHEN upper(coalesce(protocol, '')) = 'ICMP' AND icmp_type = 3 AND icmp_code IN (0, 1, 2, 3) THEN 'ICMP_Destination_Unreachable'
  WHEN upper(coalesce(protocol, '')) = 'ICMP' AND icmp_type = 11 THEN 'ICMP_Time_Exceeded'
  WHEN upper(coalesce(protocol, '')) = 'TCP' AND tcp_flags_rst IS TRUE THEN 'TCP_RST_Received'
  ELSE 'no_error_detected' END"""

oracle("packet_error", f"SELECT frame_number, {_REASON} AS packet_error_reason FROM packets")

oracle("l7_guess", """
SELECT frame_number, CASE
  WHEN upper(protocol) = 'UDP' AND (destination_port = 443 OR source_port = 443) THEN
       CASE WHEN coalesce(packet_length > 1200, false) THEN 'QUIC' ELSE 'QUIC_UDP_443' END
  WHEN upper(protocol) = 'TCP' AND coalesce(destination_port, source_port) IN (20, 21) THEN 'FTP'
  WHEN upper(protocol) = 'TCP' AND coalesce(destination_port, source_port) = 22 THEN 'SSH'
  WHEN upper(protocol) = 'TCP' AND coalesce(destination_port, source_port) = 23 THEN 'Telnet'
  WHEN upper(protocol) = 'TCP' AND coalesce(destination_port, source_port) = 25 THEN 'SMTP'
  WHEN upper(protocol) IN ('TCP', 'UDP') AND coalesce(destination_port, source_port) = 53 THEN 'DNS'
  WHEN upper(protocol) = 'TCP' AND coalesce(destination_port, source_port) = 80 THEN 'HTTP'
  WHEN upper(protocol) = 'TCP' AND coalesce(destination_port, source_port) = 110 THEN 'POP3'
  WHEN upper(protocol) = 'TCP' AND coalesce(destination_port, source_port) = 143 THEN 'IMAP'
  WHEN upper(protocol) = 'TCP' AND coalesce(destination_port, source_port) = 443 THEN 'HTTPS/TLS'
  WHEN coalesce(protocol, '') <> '' THEN upper(protocol)
  ELSE 'Unknown_L7' END AS l7_protocol_guess
FROM packets""")

_RDNS = """
rdns AS (
  SELECT trim(ip) AS ip, min(name) AS rdns FROM (
    SELECT unnest(string_split(dns_response_addresses_csv, ',')) AS ip, dns_query_name AS name
    FROM packets WHERE dns_query_name IS NOT NULL)
  WHERE trim(ip) <> '' GROUP BY 1)"""


def _service(proto: str, port: str, sni: str, host: str, quic: str, rdns: str) -> str:
    return f"""CASE
  WHEN nullif({sni}, '') IS NOT NULL THEN {sni}
  WHEN nullif({host}, '') IS NOT NULL THEN {host}
  WHEN coalesce({quic}, false) AND {port} = 443 THEN 'QUIC'
  WHEN upper({proto}) = 'TCP' AND {port} = 80 THEN 'HTTP'
  WHEN upper({proto}) = 'TCP' AND {port} = 443 THEN 'HTTPS'
  WHEN upper({proto}) = 'TCP' AND {port} = 22 THEN 'SSH'
  WHEN upper({proto}) = 'TCP' AND {port} = 993 THEN 'IMAPS'
  WHEN upper({proto}) = 'TCP' AND {port} = 465 THEN 'SMTPS'
  WHEN upper({proto}) = 'UDP' AND {port} = 53 THEN 'DNS'
  WHEN nullif(split_part({rdns}, '.', 1), '') IS NOT NULL THEN split_part({rdns}, '.', 1)
  WHEN nullif({proto}, '') IS NOT NULL AND {port} IS NOT NULL THEN upper({proto}) || '/' || CAST({port} AS VARCHAR)
  ELSE 'Unknown Service' END"""


oracle("service_guess", "WITH " + _RDNS.strip() + f"""
SELECT p.frame_number, {_service('p.protocol', 'p.destination_port', 'p.sni', 'p.http_request_host_header', 'p.is_quic', 'r.rdns')} AS service
FROM packets p LEFT JOIN rdns r ON r.ip = p.destination_ip""")

_V4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"


def _anon(col: str) -> str:
    return (f"CASE WHEN regexp_full_match({col}, '{_V4}') THEN regexp_extract({col}, '^([0-9]+\\.[0-9]+\\.[0-9]+)\\.', 1) || '.0' END")


oracle("anonymize_ip", f"""
SELECT frame_number, {_anon('source_ip')} AS source_network, {_anon('destination_ip')} AS destination_network FROM packets""")

# ---- rule features (G11) -------------------------------------------------------------------------
oracle("rule_features", "WITH " + _SIGNALS + f""",
w1 AS {nested('tcp_heuristics')},
hr AS {nested('handshake_rtt')},
base AS (
  SELECT op.*, {_REASON} AS reason, w1.heuristic_retransmission AS hrt
  FROM op LEFT JOIN w1 USING (frame_number)),
agg AS (
  SELECT client_ip, server_ip, client_port, server_port, protocol,
    false AS tcp_fin_both_sides,
    count(*) FILTER (WHERE upper(protocol) = 'TCP') AS n_tcp,
    count(*) FILTER (WHERE upper(protocol) = 'TCP' AND coalesce(hrt, false)) AS n_rt,
    arg_min(CASE WHEN is_c THEN 'client' WHEN is_s THEN 'server' END, frame_number)
      FILTER (WHERE syn AND NOT ack AND (is_c OR is_s)) AS tcp_initiator,
    arg_min(dns_response_code, frame_number) FILTER (WHERE dns_response_code IS NOT NULL) AS dns_rcode_name,
    coalesce(arg_min(reason, frame_number) FILTER (WHERE reason <> 'no_error_detected'), 'no_error_detected') AS packet_error_reason
  FROM base
  WHERE client_ip IS NOT NULL AND server_ip IS NOT NULL AND client_port IS NOT NULL AND server_port IS NOT NULL
    AND protocol IS NOT NULL
  GROUP BY client_ip, server_ip, client_port, server_port, protocol),
rtt AS (SELECT client_ip, server_ip, client_port, server_port, protocol, avg(rtt_ms) AS flow_avg_rtt_ms FROM hr GROUP BY ALL)
SELECT a.client_ip, a.server_ip, a.client_port, a.server_port, a.protocol,
  f.handshake_complete AS tcp_handshake_successful, a.tcp_fin_both_sides,
  CASE WHEN n_tcp > 0 THEN CAST(n_rt AS DOUBLE) * 100.0 / n_tcp END AS tcp_retransmission_rate_percent,
  r.flow_avg_rtt_ms, f.tls_handshake_ok AS tls_handshake_successful, a.tcp_initiator, a.dns_rcode_name,
  a.packet_error_reason
FROM agg a JOIN flows f USING (client_ip, server_ip, client_port, server_port, protocol)
LEFT JOIN rtt r USING (client_ip, server_ip, client_port, server_port, protocol)""")

oracle("retrans_severity", f"""
WITH rf AS {nested('rule_features')}
SELECT client_ip, server_ip, client_port, server_port, protocol, tcp_retransmission_rate_percent,
  CASE WHEN tcp_retransmission_rate_percent < 1.0 THEN 'Healthy' WHEN tcp_retransmission_rate_percent <= 3.0 THEN 'Warning'
       ELSE 'Critical' END AS status,
  CASE WHEN tcp_retransmission_rate_percent < 1.0 THEN '#28a745' WHEN tcp_retransmission_rate_percent <= 3.0 THEN '#ffc107'
       ELSE '#dc3545' END AS color
FROM rf WHERE tcp_retransmission_rate_percent IS NOT NULL""")

oracle("rules_outcome", f"""
WITH rf AS {nested('rule_features')}
SELECT client_ip, server_ip, client_port, server_port, protocol,
  CASE WHEN tcp_fin_both_sides IS TRUE THEN 'Connection Closed Gracefully (FINs from Both Sides)'
       WHEN tcp_handshake_successful IS TRUE THEN 'Allowed - TCP Handshake OK'
       ELSE 'Undetermined' END AS flow_disposition,
  CASE WHEN flow_avg_rtt_ms > 300 THEN 'High Network RTT (' || CAST(flow_avg_rtt_ms AS VARCHAR) || ' ms)'
       WHEN tcp_retransmission_rate_percent > 5.0
            THEN 'High TCP Retransmissions (' || CAST(tcp_retransmission_rate_percent AS VARCHAR) || ' %)'
       ELSE 'None' END AS security_observation,
  CASE WHEN dns_rcode_name = 'NXDOMAIN' THEN 'Blocked_DNS_NXDOMAIN' ELSE 'Analyzed' END AS flow_outcome
FROM rf""")

oracle("sparkline_stats", f"""
WITH s AS {nested('flow_sparkline')},
v AS (SELECT *, list_transform(string_split(sparkline_bytes_c2s, ','), lambda x: CAST(x AS BIGINT)) AS vals
      FROM s WHERE sparkline_bytes_c2s <> '')
SELECT src_ip, dest_ip, src_port, dest_port, protocol, list_min(vals) AS c2s_min, list_max(vals) AS c2s_max,
  CAST(list_sum(vals) AS DOUBLE) / len(vals) AS c2s_mean
FROM v""")

# ---- sources / sinks ---------------------------------------------------------------------------
oracle("slice_frames", """
SELECT frame_number, timestamp, source_ip, destination_ip, protocol, packet_length FROM packets
WHERE frame_number > 100 AND frame_number <= 5100 ORDER BY frame_number LIMIT 2000""")

oracle("flow_records_json", f"""
WITH t AS {nested('tag_flows')}
SELECT CAST(to_json(struct_pack(client_ip := client_ip, server_ip := server_ip, client_port := client_port,
  server_port := server_port, protocol := protocol, flow_disposition := flow_disposition, flow_cause := flow_cause,
  icmp_error_count := icmp_error_count)) AS VARCHAR) AS record
FROM t""")

oracle("filter_l7", f"""
WITH f AS {nested('flow_table')}
SELECT src_ip, dest_ip, src_port, dest_port, protocol, l7_protocol_guess, bytes_total FROM f
WHERE l7_protocol_guess IN ('HTTP', 'HTTPS/TLS')""")

# ---- J3 (brute force over pairs: fine for an oracle) ------------------------------------------
oracle("dns_sni_mismatch", """
WITH dns AS (
  SELECT source_ip AS src, dns_query_name AS q, timestamp AS t,
    list_filter(list_transform(string_split(dns_response_addresses_csv, ','), lambda x: trim(x)), lambda x: x <> '') AS ans
  FROM packets WHERE destination_port = 53 AND dns_query_name IS NOT NULL AND timestamp IS NOT NULL AND source_ip IS NOT NULL),
tls AS (
  SELECT frame_number, source_ip AS src, sni, destination_ip AS dst, timestamp AS t FROM packets
  WHERE destination_port = 443 AND sni IS NOT NULL AND timestamp IS NOT NULL),
pairs AS (
  SELECT tls.frame_number, tls.src, tls.sni, tls.dst, unnest(dns.ans) AS a
  FROM tls JOIN dns ON dns.src = tls.src AND dns.q = tls.sni AND tls.t - dns.t BETWEEN 0 AND 60)
SELECT frame_number, src AS client, sni, dst AS server, NOT bool_or(a = dst) AS mismatch
FROM pairs GROUP BY frame_number, src, sni, dst""")

# ---- enrichment ---------------------------------------------------------------------------------


# The test networks with their first and last address in hexadecimal, written out.
_NETS = """nets AS (SELECT v.*, nation.n_name AS country FROM (VALUES
  ('203.0.113.0/24', 24, 'cb007100', 'cb0071ff', 0, 'US', 'Springfield', 39.78::DOUBLE, -89.65::DOUBLE, 64500::BIGINT, 'Example Transit'),
  ('203.0.113.0/26', 26, 'cb007100', 'cb00713f', 1, 'DE', 'Musterstadt', 50.11, 8.68, 64501, 'Muster Hosting'),
  ('203.0.113.32/27', 27, 'cb007120', 'cb00713f', 2, 'IR', 'Tehran', 35.69, 51.39, 64502, 'Persia Net'),
  ('198.51.100.0/24', 24, 'c6336400', 'c63364ff', 3, 'GB', 'London', 51.51, -0.13, 64503, 'Albion Cloud'),
  ('8.8.8.0/24', 24, '08080800', '080808ff', 4, 'US', 'Mountain View', 37.39, -122.08, 64504, 'Resolver Org'),
  ('165.225.0.0/17', 17, 'a5e10000', 'a5e17fff', 5, 'CN', 'Shanghai', 31.23, 121.47, 64505, 'Edge Proxy'),
  ('100.64.0.0/10', 10, '64400000', '647fffff', 6, 'NL', 'Amsterdam', 52.37, 4.90, 64506, 'Carrier NAT'),
  ('10.1.0.0/16', 16, '0a010000', '0a01ffff', 7, 'FR', 'Paris', 48.86, 2.35, 64507, 'Campus LAN'),
  ('9.9.9.0/24', 24, '09090900', '090909ff', 8, 'BR', 'Sao Paulo', -23.55, -46.63, 64508, 'Quad Resolver'),
  ('192.0.2.0/24', 24, 'c0000200', 'c00002ff', 9, 'RU', 'Moscow', 55.76, 37.62, 64509, 'Doc Range'),
  ('2001:db8::/32', 32, '20010db8000000000000000000000000', '20010db8ffffffffffffffffffffffff', 10, 'US', 'Sixville', 40.0, -90.0, 64510, 'Six Transit'),
  ('2001:db8:cb00::/48', 48, '20010db8cb0000000000000000000000', '20010db8cb00ffffffffffffffffffff', 11, 'DE', 'Sechsdorf', 51.0, 9.0, 64511, 'Sechs Hosting'),
  ('2001:db8:cb00:7100::/59', 59, '20010db8cb0071000000000000000000', '20010db8cb00711fffffffffffffffff', 12, 'IR', 'Shesh', 36.0, 52.0, 64512, 'Shesh Net'),
  ('2001:db8:808::/47', 47, '20010db8080800000000000000000000', '20010db80809ffffffffffffffffffff', 13, 'GB', 'Sixford', 52.0, -1.0, 64513, 'Six Cloud')
  ) v(network, prefix_len, lo, hi, idx, country_iso, city, latitude, longitude, asn, asn_org)
  LEFT JOIN nation ON nation.n_nationkey = v.idx)"""


def _octet(col: str, i: int) -> str:
    return f"TRY_CAST(split_part({col}, '.', {i}) AS BIGINT)"


def _hex4(col: str) -> str:
    """The eight digits of an IPv4 address."""
    return " || ".join(f"lpad(lower(to_hex({_octet(col, i)})), 2, '0')" for i in range(1, 5))


_LPM = _NETS + f""",
ips AS (
  SELECT DISTINCT destination_ip AS ip, {_hex4('destination_ip')} AS h FROM packets WHERE destination_ip IS NOT NULL
  UNION
  SELECT '2001:db8:' || lower(to_hex({_octet('destination_ip', 1)} * 256 + {_octet('destination_ip', 2)})) || ':'
      || lower(to_hex({_octet('destination_ip', 3)} * 256 + {_octet('destination_ip', 4)})) || '::1',
    '20010db8' || {_hex4('destination_ip')} || '0000000000000001' FROM packets WHERE destination_ip IS NOT NULL),
m AS (
  SELECT ips.ip, arg_max(struct_pack(country := nets.country, city := nets.city, latitude := nets.latitude,
      longitude := nets.longitude, asn := nets.asn, asn_org := nets.asn_org, country_iso := nets.country_iso),
      nets.prefix_len) AS n
  FROM ips JOIN nets ON length(ips.h) = length(nets.lo) AND ips.h BETWEEN nets.lo AND nets.hi GROUP BY ips.ip),
lpm AS (SELECT ips.ip, m.n FROM ips LEFT JOIN m USING (ip))"""

oracle("ip_geo", "WITH " + _LPM + """
SELECT ip, n.country AS country, n.city AS city, n.latitude AS latitude, n.longitude AS longitude FROM lpm""")

oracle("ip_asn", "WITH " + _LPM + """
SELECT ip, n.asn AS asn_number, n.asn_org AS asn_organization FROM lpm""")

oracle("ip_rdns", "WITH " + _RDNS.strip() + """,
ips AS (SELECT DISTINCT destination_ip AS ip FROM packets WHERE destination_ip IS NOT NULL)
SELECT ips.ip, rdns.rdns FROM ips LEFT JOIN rdns USING (ip)""")

oracle("enrich_ips", "WITH " + _LPM + "," + _RDNS + """
SELECT lpm.ip, n.country AS country, n.city AS city, n.latitude AS latitude, n.longitude AS longitude,
  n.asn AS asn_number, n.asn_org AS asn_organization, rdns.rdns
FROM lpm LEFT JOIN rdns USING (ip)""")

_UNUSUAL = _NETS + f""",
ft AS {nested('flow_table')},
ftc AS (
  SELECT ft.*, (SELECT arg_max(nets.country_iso, nets.prefix_len) FROM nets
                WHERE length(nets.lo) = 8 AND {_hex4('ft.dest_ip')} BETWEEN nets.lo AND nets.hi) AS dest_country
  FROM ft),
unusual AS (
  SELECT src_ip, dest_ip, src_port, dest_port, protocol, dest_country FROM ftc
  WHERE dest_country IS NOT NULL AND dest_country NOT IN {_COMMON})"""

oracle("unusual_countries", "WITH " + _UNUSUAL + " SELECT * FROM unusual")

# ---- aggregations -----------------------------------------------------------------------------
oracle("protocol_counts", """
SELECT lower(protocol) AS protocol, count(*) AS packets FROM packets
WHERE protocol IS NOT NULL AND protocol <> '' GROUP BY 1""")

oracle("top_ports", """
WITH c AS (
  SELECT lower(protocol) || '_' || CAST(coalesce(destination_port, 0) AS VARCHAR) AS port_key, count(*) AS packets
  FROM packets WHERE lower(protocol) IN ('tcp', 'udp') GROUP BY 1)
SELECT port_key, upper(split_part(port_key, '_', 1)) AS protocol, TRY_CAST(split_part(port_key, '_', 2) AS BIGINT) AS port,
  packets
FROM c ORDER BY packets DESC, port_key ASC LIMIT 10""")

oracle("tls_versions", """
SELECT tls_effective_version AS tls_version, count(*) AS packets FROM packets
WHERE tls_effective_version IS NOT NULL AND tls_effective_version <> '' GROUP BY 1""")

oracle("timeline", """
SELECT CAST(trunc(coalesce(timestamp, 0.0)) AS BIGINT) AS second, sum(coalesce(packet_length, 0))::BIGINT AS bytes,
  count(*) AS packets
FROM packets GROUP BY 1""")

oracle("timeline_spikes", f"""
WITH tl AS {nested('timeline')},
st AS (SELECT avg(bytes) AS m, stddev_pop(bytes) AS s, count(DISTINCT bytes) AS nd FROM tl)
SELECT second, bytes, packets FROM tl, st WHERE nd > 1 AND s > 0 AND bytes > m + 3.0 * s""")

oracle("rtt_stats", f"""
WITH hr AS {nested('handshake_rtt')}
SELECT quantile_cont(rtt_ms, 0.5) AS median, quantile_cont(rtt_ms, 0.95) AS p95, min(rtt_ms) AS min,
  max(rtt_ms) AS max, count(rtt_ms) AS samples,
  CASE WHEN count(rtt_ms) = 0 THEN 'insufficient_syn_ack_pairs' END AS reason
FROM hr""")

oracle("performance_summary", f"""
WITH hr AS {nested('handshake_rtt')},
ta AS {nested('tls_time_to_alert')},
w1 AS {nested('tcp_heuristics')},
r AS (SELECT quantile_cont(rtt_ms, 0.5) AS rtt_median_ms, quantile_cont(rtt_ms, 0.95) AS rtt_p95_ms,
        min(rtt_ms) AS rtt_min_ms, max(rtt_ms) AS rtt_max_ms, count(rtt_ms) AS rtt_samples,
        quantile_cont(rtt_ms, 0.5) AS tcp_syn_rtt_ms, count(rtt_ms) = 0 AS rtt_limited_data FROM hr),
a AS (SELECT quantile_cont(time_to_alert_ms, 0.5) AS tls_time_to_alert_ms FROM ta),
n AS (SELECT count(*) AS n FROM packets WHERE upper(protocol) = 'TCP'),
rt AS (SELECT sum(heuristic_retransmission::INT) AS r FROM w1)
SELECT r.*, a.tls_time_to_alert_ms,
  CASE WHEN n.n > 0 THEN CAST(coalesce(rt.r, 0) AS DOUBLE) * 100.0 / n.n ELSE 0.0 END AS tcp_retransmission_ratio_percent
FROM r, a, n, rt""")

oracle("service_overview", f"""
WITH fs AS {nested('flow_summary')}, {_RDNS.strip()}
SELECT {_service('fs.protocol', 'fs.dest_port', 'fs.sni_hostname', 'fs.http_host', 'NULL', 'rdns.rdns')} AS service,
  count(*) AS flow_count, sum(coalesce(bytes_total, 0))::BIGINT AS bytes
FROM fs LEFT JOIN rdns ON rdns.ip = fs.dest_ip GROUP BY 1""")

# Flows tagged on their evidence: any RST, first fatal alert, first ICMP error, its sender, first
# method and TLS version, any self-signed certificate.
_FLOWS = _SIGNALS.split(""",
sig AS""")[0].strip() + """,
ev AS (
  SELECT client_ip, server_ip, client_port, server_port, protocol, bool_or(rst) AS any_rst,
    arg_min(tls_alert_message_description, frame_number) FILTER (WHERE tls_alert_level = 'fatal' AND tls_alert_message_description IS NOT NULL) AS fatal,
    arg_min(struct_pack(t := icmp_type, c := icmp_code), frame_number) FILTER (WHERE upper(protocol) IN ('ICMP', 'ICMPV6') AND icmp_type IN (3, 11)) AS icmp,
    arg_min(source_ip, frame_number) FILTER (WHERE rst OR (upper(protocol) IN ('ICMP', 'ICMPV6') AND icmp_type IN (3, 11))) AS sender,
    arg_min(http_request_method, frame_number) FILTER (WHERE http_request_method IS NOT NULL) AS method,
    arg_min(tls_effective_version, frame_number) FILTER (WHERE tls_effective_version IS NOT NULL) AS version,
    bool_or(tls_cert_is_self_signed IS TRUE) AS self_signed
  FROM op
  WHERE client_ip IS NOT NULL AND server_ip IS NOT NULL AND client_port IS NOT NULL AND server_port IS NOT NULL AND protocol IS NOT NULL
  GROUP BY client_ip, server_ip, client_port, server_port, protocol),
tf AS (
  SELECT *, client_ip || '|' || server_ip || '|' || client_port || '|' || server_port || '|' || protocol AS flow_id,
    CASE WHEN protocol = 'TCP' AND any_rst THEN 'TCP_RESET'
         WHEN fatal IS NOT NULL THEN 'TLS_FATAL_' || fatal
         WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp.t = 3 AND icmp.c = 1 THEN 'ICMP_DEST_UNREACHABLE_HOST' END AS error_type,
    CASE WHEN protocol = 'TCP' AND any_rst THEN 'Source: ' || coalesce(sender, client_ip)
         WHEN fatal IS NOT NULL THEN fatal
         WHEN protocol IN ('ICMP', 'ICMPv6') AND icmp.t = 3 AND icmp.c = 1 THEN 'Source: ' || coalesce(sender, client_ip) END AS error_detail
  FROM ev)"""

_ERR = _FLOWS + """,
summ AS (
  SELECT error_type, error_detail, count(*) AS count, list_slice(list_sort(list(DISTINCT flow_id)), 1, 3) AS sample_flow_ids
  FROM tf WHERE error_type IS NOT NULL AND error_detail IS NOT NULL GROUP BY error_type, error_detail)"""

oracle("error_summary", "WITH " + _ERR + " SELECT * FROM summ")
oracle("error_rows", "WITH " + _ERR + """
SELECT error_type AS "Type", coalesce(error_detail, '') AS "Description", count AS "Count" FROM summ""")
oracle("error_total", "WITH " + _ERR + " SELECT coalesce(sum(count), 0)::BIGINT AS total_errors FROM summ")

_FIND = _FLOWS + """,
findings AS (
  SELECT 'plaintext_http_flows' AS finding, '' AS detail, count(*) FILTER (WHERE server_port = 80 AND method IS NOT NULL) AS flows FROM tf
  UNION ALL
  SELECT 'self_signed_certificate_flows', '', count(*) FILTER (WHERE self_signed) FROM tf
  UNION ALL
  SELECT 'outdated_tls_version_counts', version, count(*) FROM tf WHERE version IN ('TLS 1.0', 'TLS 1.1') GROUP BY 2)"""

oracle("security_findings", "WITH " + _FIND + " SELECT * FROM findings")
oracle("security_total", "WITH " + _FIND + "," + _UNUSUAL + """
SELECT ((SELECT coalesce(sum(flows), 0) FROM findings) + (SELECT count(*) FROM unusual))::BIGINT AS security_issues""")

oracle("plaintext_flows", """
SELECT count(*) AS plaintext_flows FROM (
  SELECT DISTINCT source_ip, destination_ip, source_port, destination_port, upper(coalesce(protocol, '')) AS p
  FROM packets
  WHERE upper(coalesce(protocol, '')) = 'HTTP'
     OR (upper(coalesce(protocol, '')) = 'TCP' AND destination_port = 80 AND coalesce(http_request_method, '') <> ''))""")

oracle("outcome_by_protocol", f"""
WITH o AS {nested('rules_outcome')}
SELECT protocol, flow_outcome, count(*) AS flows FROM o GROUP BY ALL""")

oracle("errors_by_reason", f"""
SELECT {_REASON} AS packet_error_reason, count(DISTINCT {_FLOW_KEY}) AS affected_flows,
  sum(packet_length)::BIGINT AS total_bytes, min(timestamp) AS first_seen
FROM packets GROUP BY 1""")

oracle("capture_info", """
SELECT count(*) AS total_packets, min(timestamp) AS first_timestamp, max(timestamp) AS last_timestamp,
  count(*) FILTER (WHERE is_quic IS TRUE) AS quic_packets,
  count(*) FILTER (WHERE tls_effective_version IS NOT NULL OR tls_handshake_type IS NOT NULL) AS tls_packets,
  max(timestamp) - min(timestamp) AS capture_duration
FROM packets""")

# ---- top-k -------------------------------------------------------------------------------------
oracle("top_by_bytes", f"""
WITH f AS {nested('flow_table')}
SELECT * FROM f ORDER BY bytes_total DESC, src_ip, dest_ip, src_port, dest_port, protocol LIMIT 20""")

oracle("top_by_packets", f"""
WITH f AS {nested('flow_table')}
SELECT * FROM f ORDER BY pkts_total DESC, src_ip, dest_ip, src_port, dest_port, protocol LIMIT 20""")

oracle("top_flows", f"""
WITH fs AS {nested('flow_summary')},
sc AS (
  SELECT *, trim(security_observations) AS o FROM fs),
sc2 AS (
  SELECT *,
    ((0.0::DOUBLE + CASE WHEN starts_with(coalesce(flow_disposition, ''), 'Blocked') THEN 1000
                        WHEN contains(coalesce(flow_disposition, ''), 'Degraded') THEN 500 ELSE 0 END)
     + CAST(200 * CASE WHEN o IS NOT NULL AND o <> '' AND lower(o) <> 'none'
                       THEN len(list_filter(regexp_split_to_array(o, '[;,]+'), lambda x: trim(x) <> '')) ELSE 0 END AS DOUBLE))
     + CAST(coalesce(bytes_total, 0) AS DOUBLE) / 1000000.0 AS score
  FROM sc)
SELECT src_ip, dest_ip, src_port, dest_port, protocol, flow_disposition, security_observations, bytes_total, score
FROM sc2 ORDER BY score DESC, src_ip, dest_ip, src_port, dest_port, protocol LIMIT 20""")

oracle("spike_top_flows", f"""
WITH sp AS {nested('timeline_spikes')},
f AS {nested('flow_table')},
j AS (
  SELECT sp.second, f.src_ip, f.dest_ip, f.src_port, f.dest_port, f.protocol, f.bytes_total,
    row_number() OVER (PARTITION BY sp.second ORDER BY f.bytes_total DESC, f.src_ip, f.dest_ip, f.src_port,
                       f.dest_port, f.protocol) AS rank
  FROM sp JOIN f ON f.start_ts <= sp.second AND f.end_ts >= sp.second)
SELECT second, rank, src_ip, dest_ip, src_port, dest_port, protocol, bytes_total FROM j WHERE rank <= 5""")

oracle("tag_flows_app", f"""
WITH t AS {nested('tag_flows')},
m AS {nested('dns_sni_mismatch')},
mm AS (
  SELECT DISTINCT CASE WHEN p.is_source_client THEN p.source_ip ELSE p.destination_ip END AS client_ip,
    CASE WHEN p.is_source_client THEN p.destination_ip ELSE p.source_ip END AS server_ip,
    CASE WHEN p.is_source_client THEN p.source_port ELSE p.destination_port END AS client_port,
    CASE WHEN p.is_source_client THEN p.destination_port ELSE p.source_port END AS server_port,
    p.protocol
  FROM packets p JOIN m ON m.frame_number = p.frame_number WHERE m.mismatch),
x AS (
  SELECT t.*, mm.client_ip IS NOT NULL AS is_mm,
    (t.protocol = 'HTTP' AND EXISTS (SELECT 1 FROM packets q WHERE q.http_response_code = 407
       AND (CASE WHEN q.is_source_client THEN q.source_ip ELSE q.destination_ip END) = t.client_ip
       AND (CASE WHEN q.is_source_client THEN q.destination_ip ELSE q.source_ip END) = t.server_ip
       AND (CASE WHEN q.is_source_client THEN q.source_port ELSE q.destination_port END) = t.client_port
       AND (CASE WHEN q.is_source_client THEN q.destination_port ELSE q.source_port END) = t.server_port
       AND q.protocol = t.protocol)) AS is_407
  FROM t LEFT JOIN mm USING (client_ip, server_ip, client_port, server_port, protocol))
SELECT flow_id, client_ip, server_ip, client_port, server_port, protocol,
  CASE WHEN flow_cause IN ('Undetermined', 'Downstream ICMP errors') AND is_407 THEN 'Blocked'
       WHEN flow_cause IN ('Undetermined', 'Downstream ICMP errors') AND is_mm THEN 'Mis-routed'
       ELSE flow_disposition END AS flow_disposition,
  CASE WHEN flow_cause IN ('Undetermined', 'Downstream ICMP errors') AND is_407 THEN 'Proxy Authentication Failed'
       WHEN flow_cause IN ('Undetermined', 'Downstream ICMP errors') AND is_mm THEN 'DNS answer set doesn’t include TLS target'
       ELSE flow_cause END AS flow_cause,
  icmp_error_count, tls_handshake_ok, first_alert_time, time_to_alert
FROM x""")

# ---- T4, and dispositions on input where every rule fires ------------------------------------------
oracle("summary_sorted", f"""
WITH fs AS {nested('flow_summary')}
SELECT (row_number() OVER (ORDER BY start_time, src_ip, dest_ip, src_port, dest_port, protocol) - 1)::BIGINT AS place,
  start_time, src_ip, dest_ip, src_port, dest_port, protocol FROM fs""")

_HTTP = """hp AS (
  SELECT * REPLACE (CASE WHEN http_request_method IS NOT NULL OR http_response_code IS NOT NULL THEN 'HTTP' ELSE protocol END AS protocol)
  FROM packets)"""

oracle("proxy_407", f"""
WITH {_HTTP}
SELECT frame_number, coalesce(protocol = 'HTTP' AND http_response_code = 407, false) AS is_proxy_407 FROM hp""")

oracle("flow_disposition", f"WITH {_HTTP}," + _SIGNALS.replace("FROM packets", "FROM hp") + """,
h AS (SELECT client_ip, server_ip, client_port, server_port, protocol, coalesce(bool_or(http_response_code = 407), false) AS is_407
      FROM op GROUP BY client_ip, server_ip, client_port, server_port, protocol)
SELECT f.client_ip, f.server_ip, f.client_port, f.server_port, f.protocol,
  CASE WHEN handshake_complete AND data_both THEN 'Allowed' WHEN rst_after_syn THEN 'Blocked' WHEN icmp_error THEN 'Degraded'
       WHEN f.protocol = 'HTTP' AND is_407 THEN 'Blocked' ELSE 'Unknown' END AS flow_disposition,
  CASE WHEN handshake_complete AND data_both THEN 'Completed TCP session with data exchange'
       WHEN rst_after_syn THEN 'TCP RST from destination after SYN'
       WHEN icmp_error THEN 'ICMP Destination Unreachable/Time Exceeded in flow'
       WHEN f.protocol = 'HTTP' AND is_407 THEN 'Proxy Authentication Failed' ELSE 'Undetermined' END AS flow_cause
FROM flows f JOIN h USING (client_ip, server_ip, client_port, server_port, protocol)""")

# ---- several captures in one table: each report, computed on each capture by itself -----------------


def _one_capture(name: str, rows: str) -> str:
    body = RAW[name]
    rest = "," + body[5:] if body.upper().startswith("WITH ") else body
    return f"(WITH packets AS ({rows}){rest if rest.startswith(',') else ' ' + rest})"


for _name in ("capture_info", "top_ports", "timeline_spikes", "spike_top_flows", "top_by_bytes", "performance_summary", "rtt_stats",
              "error_summary", "error_total", "security_findings", "plaintext_flows", "rule_features", "tcp_heuristics"):
    oracle(f"{_name}_by_capture", f"""
WITH every AS (SELECT * FROM packets)
SELECT 'a' AS capture_id, * FROM {_one_capture(_name, "SELECT * FROM every")}
UNION ALL
SELECT 'b' AS capture_id, * FROM {_one_capture(_name, "SELECT * REPLACE (packet_length + frame_number % 7 AS packet_length) FROM every WHERE frame_number % 40 < 30")}""")

# ---- conformed input --------------------------------------------------------------------------------
oracle("conformed_tag_flows", RAW["tag_flows"])

oracle("conformed_retransmissions", f"""
WITH h AS {nested('tcp_heuristics')}
SELECT frame_number, CASE frame_number % 50 WHEN 3 THEN true WHEN 4 THEN false ELSE heuristic_retransmission END AS heuristic_retransmission
FROM h""")
