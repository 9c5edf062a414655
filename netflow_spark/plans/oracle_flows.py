"""DuckDB oracles for flow construction, joins and ordered analytics."""

from __future__ import annotations

from .oracle import _ORIENTED, _SIGNALS, oracle
from .oracle_rules import DISPOSITION_CASE, OBSERVATION_CASE, RULE_INPUT_CTE, TRAFFIC_TYPE_CASE

_FLOW_KEY = """CASE
  WHEN coalesce(source_ip, '') <> '' AND coalesce(destination_ip, '') <> '' AND coalesce(protocol, '') <> '' THEN
    CASE WHEN source_ip < destination_ip OR (source_ip = destination_ip AND coalesce(source_port, 0) <= coalesce(destination_port, 0))
         THEN protocol || '_' || source_ip || ':' || CAST(coalesce(source_port, 0) AS VARCHAR) || '_' || destination_ip || ':' || CAST(coalesce(destination_port, 0) AS VARCHAR)
         ELSE protocol || '_' || destination_ip || ':' || CAST(coalesce(destination_port, 0) AS VARCHAR) || '_' || source_ip || ':' || CAST(coalesce(source_port, 0) AS VARCHAR) END
  ELSE 'UNKNOWN_FLOW_' || CAST(frame_number AS VARCHAR) END"""

oracle("flow_key", f"SELECT frame_number, {_FLOW_KEY} AS flow_key FROM packets")

oracle("orient", f"""
WITH k AS (
  SELECT *, {_FLOW_KEY} AS flow_key,
    (upper(protocol) = 'TCP' AND tcp_flags_syn IS TRUE AND tcp_flags_ack IS NOT TRUE) OR upper(protocol) = 'UDP' AS q
  FROM packets),
f AS (
  SELECT flow_key, min(frame_number) FILTER (WHERE q) AS qf,
    arg_min(struct_pack(ip := source_ip, port := source_port), frame_number) FILTER (WHERE q) AS c
  FROM k GROUP BY flow_key)
SELECT k.frame_number, k.flow_key,
  CASE WHEN f.qf IS NULL OR k.frame_number <= f.qf THEN true
       ELSE (k.source_ip IS NOT DISTINCT FROM f.c.ip AND k.source_port IS NOT DISTINCT FROM f.c.port) END AS is_source_client
FROM k JOIN f USING (flow_key)""")

oracle("orient_parser", """
WITH f AS (
  SELECT source_ip, source_port, destination_ip, destination_port, min(frame_number) AS sf
  FROM packets WHERE protocol = 'TCP' AND tcp_flags_syn IS TRUE AND tcp_flags_ack IS NOT TRUE
  GROUP BY ALL)
SELECT p.frame_number,
  CASE WHEN p.protocol = 'TCP' AND p.frame_number >= f.sf THEN true END AS is_src_client
FROM packets p LEFT JOIN f
  ON p.source_ip IS NOT DISTINCT FROM f.source_ip AND p.source_port IS NOT DISTINCT FROM f.source_port
 AND p.destination_ip IS NOT DISTINCT FROM f.destination_ip AND p.destination_port IS NOT DISTINCT FROM f.destination_port""")

_KEYED = """
kd AS (
  SELECT *,
    CASE WHEN coalesce(is_source_client, false) THEN coalesce(source_ip, '') ELSE coalesce(destination_ip, '') END AS src_ip,
    CASE WHEN coalesce(is_source_client, false) THEN coalesce(destination_ip, '') ELSE coalesce(source_ip, '') END AS dest_ip,
    CASE WHEN coalesce(is_source_client, false) THEN coalesce(source_port, 0) ELSE coalesce(destination_port, 0) END AS src_port,
    CASE WHEN coalesce(is_source_client, false) THEN coalesce(destination_port, 0) ELSE coalesce(source_port, 0) END AS dest_port,
    coalesce(protocol, '') AS proto, coalesce(is_source_client, false) AS c2s,
    coalesce(packet_length, 0) AS len, timestamp AS ts
  FROM packets)"""

_L7 = """CASE
  WHEN upper(protocol) = 'UDP' AND (dest_port = 443 OR src_port = 443) THEN 'QUIC_UDP_443'
  WHEN upper(protocol) = 'TCP' AND dest_port IN (20, 21) THEN 'FTP'
  WHEN upper(protocol) = 'TCP' AND dest_port = 22 THEN 'SSH'
  WHEN upper(protocol) = 'TCP' AND dest_port = 23 THEN 'Telnet'
  WHEN upper(protocol) = 'TCP' AND dest_port = 25 THEN 'SMTP'
  WHEN upper(protocol) IN ('TCP', 'UDP') AND dest_port = 53 THEN 'DNS'
  WHEN upper(protocol) = 'TCP' AND dest_port = 80 THEN 'HTTP'
  WHEN upper(protocol) = 'TCP' AND dest_port = 110 THEN 'POP3'
  WHEN upper(protocol) = 'TCP' AND dest_port = 143 THEN 'IMAP'
  WHEN upper(protocol) = 'TCP' AND dest_port = 443 THEN 'HTTPS/TLS'
  WHEN coalesce(protocol, '') <> '' THEN upper(protocol)
  ELSE 'Unknown_L7' END"""

oracle("flow_table", "WITH " + _KEYED + f""",
g AS (
  SELECT src_ip, dest_ip, src_port, dest_port, proto AS protocol,
    sum(CASE WHEN c2s THEN len ELSE 0 END)::BIGINT AS bytes_c2s,
    sum(CASE WHEN NOT c2s THEN len ELSE 0 END)::BIGINT AS bytes_s2c,
    sum(CASE WHEN c2s THEN 1 ELSE 0 END)::BIGINT AS pkts_c2s,
    sum(CASE WHEN NOT c2s THEN 1 ELSE 0 END)::BIGINT AS pkts_s2c,
    coalesce(min(ts), 0.0) AS start_ts, coalesce(max(ts), 0.0) AS end_ts
  FROM kd GROUP BY ALL)
SELECT src_ip, dest_ip, src_port, dest_port, protocol, {_L7} AS l7_protocol_guess,
  bytes_c2s, bytes_s2c, bytes_c2s + bytes_s2c AS bytes_total,
  pkts_c2s, pkts_s2c, pkts_c2s + pkts_s2c AS pkts_total, start_ts, end_ts
FROM g""")

oracle("flow_sparkline", "WITH " + _KEYED + """,
timed AS (SELECT *, CASE WHEN max(ts) OVER (PARTITION BY src_ip, dest_ip, src_port, dest_port, proto) IS NULL THEN 0 ELSE ts END AS t FROM kd),
s AS (SELECT src_ip, dest_ip, src_port, dest_port, proto, c2s, CAST(trunc(t) AS BIGINT) AS sec, sum(len)::BIGINT AS b
      FROM timed GROUP BY ALL),
r AS (SELECT src_ip, dest_ip, src_port, dest_port, proto, min(sec) AS lo, max(sec) AS hi,
             bool_or(c2s) AS has_c, bool_or(NOT c2s) AS has_s FROM s GROUP BY ALL),
grid AS (SELECT r.*, unnest(generate_series(lo, hi)) AS sec FROM r),
filled AS (
  SELECT g.src_ip, g.dest_ip, g.src_port, g.dest_port, g.proto, g.sec, g.has_c, g.has_s,
    coalesce(sc.b, 0) AS bc, coalesce(ss.b, 0) AS bs
  FROM grid g
  LEFT JOIN s sc ON sc.src_ip = g.src_ip AND sc.dest_ip = g.dest_ip AND sc.src_port = g.src_port
    AND sc.dest_port = g.dest_port AND sc.proto = g.proto AND sc.sec = g.sec AND sc.c2s
  LEFT JOIN s ss ON ss.src_ip = g.src_ip AND ss.dest_ip = g.dest_ip AND ss.src_port = g.src_port
    AND ss.dest_port = g.dest_port AND ss.proto = g.proto AND ss.sec = g.sec AND NOT ss.c2s)
SELECT src_ip, dest_ip, src_port, dest_port, proto AS protocol,
  CASE WHEN any_value(has_c) THEN string_agg(CAST(bc AS VARCHAR), ',' ORDER BY sec) ELSE '' END AS sparkline_bytes_c2s,
  CASE WHEN any_value(has_s) THEN string_agg(CAST(bs AS VARCHAR), ',' ORDER BY sec) ELSE '' END AS sparkline_bytes_s2c
FROM filled GROUP BY src_ip, dest_ip, src_port, dest_port, proto""")

oracle("flow_signals", "WITH " + _SIGNALS + """
SELECT client_ip, server_ip, client_port, server_port, protocol, handshake_complete, data_both,
       rst_after_syn, icmp_error, first_syn_time, first_rst_time FROM flows""")

oracle("tls_outcome", "WITH " + _SIGNALS + """
SELECT client_ip, server_ip, client_port, server_port, protocol, first_client_hello_time,
       first_server_hello_time, tls_handshake_ok, first_alert_time, time_to_alert FROM flows""")

oracle("flow_summary", "WITH " + RULE_INPUT_CTE + f""",
t AS (
  SELECT *, {DISPOSITION_CASE} AS disp, {TRAFFIC_TYPE_CASE} AS tt, {OBSERVATION_CASE} AS obs,
    coalesce(is_source_client, false) AS c2s
  FROM ri),
k AS (
  SELECT *,
    CASE WHEN c2s THEN source_ip ELSE destination_ip END AS s_ip,
    CASE WHEN c2s THEN destination_ip ELSE source_ip END AS d_ip,
    CASE WHEN c2s THEN source_port ELSE destination_port END AS s_port,
    CASE WHEN c2s THEN destination_port ELSE source_port END AS d_port,
    CASE disp WHEN 'Blocked' THEN 0 WHEN 'Degraded' THEN 1 WHEN 'Allowed' THEN 2 WHEN 'Unknown' THEN 3 ELSE 4 END AS disp_rank,
    CASE tt WHEN 'HTTPS' THEN 0 WHEN 'TLS' THEN 1 WHEN 'HTTP' THEN 2 WHEN 'DNS' THEN 3 WHEN 'SSH' THEN 4
            WHEN 'ICMP' THEN 5 WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 7 WHEN 'OTHER' THEN 8 ELSE 9 END AS tt_rank,
    coalesce(list_contains(dns_response_addresses, CASE WHEN c2s THEN destination_ip ELSE source_ip END), false) AS hit
  FROM t),
obs_tokens AS (
  SELECT DISTINCT s_ip, d_ip, s_port, d_port, protocol, trim(tok) AS tok
  FROM (SELECT s_ip, d_ip, s_port, d_port, protocol, unnest(string_split(obs, ';')) AS tok FROM k WHERE obs IS NOT NULL)
  WHERE trim(tok) <> ''),
obs_join AS (
  SELECT s_ip, d_ip, s_port, d_port, protocol, string_agg(tok, ';' ORDER BY tok) AS security_observations
  FROM obs_tokens GROUP BY ALL),
g AS (
  SELECT s_ip, d_ip, s_port, d_port, protocol,
    min(timestamp) AS start_time, max(timestamp) AS end_time,
    sum(CASE WHEN c2s THEN 1 ELSE 0 END)::BIGINT AS pkts_c2s,
    sum(CASE WHEN NOT c2s THEN 1 ELSE 0 END)::BIGINT AS pkts_s2c,
    sum(CASE WHEN c2s THEN coalesce(packet_length, 0) ELSE 0 END)::BIGINT AS bytes_c2s,
    sum(CASE WHEN NOT c2s THEN coalesce(packet_length, 0) ELSE 0 END)::BIGINT AS bytes_s2c,
    arg_min(disp, (disp_rank, disp)) FILTER (WHERE disp IS NOT NULL) AS flow_disposition,
    arg_min(tt, (tt_rank, frame_number)) FILTER (WHERE tt IS NOT NULL) AS primary_traffic_type_guess,
    arg_min(sni, frame_number) FILTER (WHERE sni IS NOT NULL) AS sni_hostname,
    arg_min(http_request_host_header, frame_number) FILTER (WHERE http_request_host_header IS NOT NULL) AS http_host,
    arg_min(http_request_uri, frame_number) FILTER (WHERE http_request_uri IS NOT NULL) AS http_path,
    arg_min(dns_query_name, frame_number) FILTER (WHERE dns_query_name IS NOT NULL) AS q_first,
    arg_min(dns_response_code, frame_number) FILTER (WHERE dns_response_code IS NOT NULL) AS rc_first,
    arg_max(struct_pack(q := dns_query_name, rc := dns_response_code), (timestamp, -frame_number))
      FILTER (WHERE hit) AS dns_hit,
    bool_or(hit) AS any_hit
  FROM k
  WHERE s_ip IS NOT NULL AND d_ip IS NOT NULL AND s_port IS NOT NULL AND d_port IS NOT NULL AND protocol IS NOT NULL
  GROUP BY ALL)
SELECT g.s_ip AS src_ip, g.d_ip AS dest_ip, g.s_port AS src_port, g.d_port AS dest_port, g.protocol,
  start_time, end_time, (end_time - start_time) * 1000 AS duration_ms,
  pkts_c2s, pkts_s2c, pkts_c2s + pkts_s2c AS pkts_total,
  bytes_c2s, bytes_s2c, bytes_c2s + bytes_s2c AS bytes_total,
  flow_disposition, primary_traffic_type_guess, o.security_observations,
  sni_hostname, http_host, http_path,
  CASE WHEN any_hit THEN dns_hit.q ELSE q_first END AS dns_query,
  CASE WHEN any_hit THEN dns_hit.rc ELSE rc_first END AS dns_response_code
FROM g LEFT JOIN obs_join o
  ON o.s_ip = g.s_ip AND o.d_ip = g.d_ip AND o.s_port = g.s_port AND o.d_port = g.d_port AND o.protocol = g.protocol""")

oracle("icmp_correlate", "WITH " + _ORIENTED.strip() + """,
errs AS (
  SELECT frame_number AS e_frame, icmp_original_destination_ip AS q_ip,
    CAST(icmp_original_destination_port AS BIGINT) AS q_port,
    CASE WHEN icmp_original_protocol <> '' THEN upper(icmp_original_protocol) END AS q_proto,
    CAST(icmp_original_ip_id AS BIGINT) AS q_ipid
  FROM packets WHERE upper(protocol) IN ('ICMP', 'ICMPV6') AND icmp_type IN (3, 11)),
cands AS (
  SELECT frame_number AS c_frame, destination_ip AS q_ip, CAST(destination_port AS BIGINT) AS q_port,
    upper(protocol) AS q_proto, CAST(ip_id AS BIGINT) AS q_ipid,
    client_ip, server_ip, client_port, server_port, protocol
  FROM op
  WHERE coalesce(upper(protocol) NOT IN ('ICMP', 'ICMPV6'), true) AND is_source_client IS NOT NULL
    AND client_ip IS NOT NULL AND server_ip IS NOT NULL AND client_port IS NOT NULL
    AND server_port IS NOT NULL AND protocol IS NOT NULL),
ranked AS (
  SELECT e.e_frame, c.client_ip, c.server_ip, c.client_port, c.server_port, c.protocol,
    row_number() OVER (PARTITION BY e.e_frame ORDER BY c.c_frame DESC) AS rn
  FROM errs e JOIN cands c
    ON c.q_ip IS NOT DISTINCT FROM e.q_ip AND c.q_port IS NOT DISTINCT FROM e.q_port
   AND c.q_proto IS NOT DISTINCT FROM e.q_proto AND c.q_ipid IS NOT DISTINCT FROM e.q_ipid
   AND c.c_frame < e.e_frame)
SELECT client_ip, server_ip, client_port, server_port, protocol, count(*) AS icmp_error_count
FROM ranked WHERE rn = 1 GROUP BY ALL""")

oracle("tcp_heuristics", """
WITH t AS (
  SELECT frame_number,
    coalesce(source_ip, '') AS k1, CASE WHEN coalesce(source_port, 0) = 0 THEN -1 ELSE source_port END AS k2,
    coalesce(destination_ip, '') AS k3, CASE WHEN coalesce(destination_port, 0) = 0 THEN -1 ELSE destination_port END AS k4,
    tcp_sequence_number AS seq, tcp_acknowledgment_number AS ack, tcp_window_size AS win,
    coalesce(tcp_payload_length, 0) AS len
  FROM packets WHERE protocol = 'TCP'),
h AS (
  SELECT *,
    list({'seq': seq, 'ack': ack, 'win': win, 'len': len}) OVER (PARTITION BY k1, k2, k3, k4 ORDER BY frame_number
      ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS hist
  FROM t),
f AS (
  SELECT *, len(hist) > 0 AS has, hist[-1] AS last,
    coalesce(list_contains(list_filter(list_transform(hist, lambda x: x.seq), lambda x: x IS NOT NULL), seq), false) AS seen
  FROM h)
SELECT frame_number,
  (seq IS NOT NULL AND seen) AS heuristic_retransmission,
  coalesce(has AND ack = last.ack AND len = 0, false) AS heuristic_duplicate_ack,
  coalesce(has AND seq < coalesce(last.seq, 0) + coalesce(last.len, 0) AND NOT seen, false) AS heuristic_out_of_order,
  coalesce(has AND win = 0 AND last.win <> 0, false) AS heuristic_zero_window
FROM f""")

oracle("packet_rtt", """
WITH s AS (
  SELECT frame_number, timestamp AS ts, NOT coalesce(tcp_flags_ack, false) AS is_syn,
    CASE WHEN NOT coalesce(tcp_flags_ack, false) THEN source_ip ELSE destination_ip END AS a_ip,
    CASE WHEN NOT coalesce(tcp_flags_ack, false) THEN source_port ELSE destination_port END AS a_port,
    CASE WHEN NOT coalesce(tcp_flags_ack, false) THEN destination_ip ELSE source_ip END AS b_ip,
    CASE WHEN NOT coalesce(tcp_flags_ack, false) THEN destination_port ELSE source_port END AS b_port
  FROM packets
  WHERE protocol = 'TCP' AND tcp_flags_syn IS TRUE AND source_ip IS NOT NULL AND destination_ip IS NOT NULL
    AND source_port IS NOT NULL AND destination_port IS NOT NULL),
l AS (
  SELECT *, lag(is_syn) OVER w AS p_syn, lag(ts) OVER w AS p_ts FROM s
  WINDOW w AS (PARTITION BY a_ip, a_port, b_ip, b_port ORDER BY frame_number))
SELECT frame_number, (ts - p_ts) * 1000.0 AS tcp_rtt_ms FROM l WHERE NOT is_syn AND p_syn IS TRUE""")

oracle("handshake_rtt", "WITH " + _ORIENTED.strip() + """,
s AS (
  SELECT client_ip, server_ip, client_port, server_port, protocol, frame_number, timestamp AS ts,
    (is_c AND syn AND NOT ack) AS is_syn, coalesce(tcp_sequence_number, 0) AS seq,
    coalesce(tcp_acknowledgment_number, -1) AS ackn
  FROM op WHERE upper(protocol) = 'TCP' AND ((is_c AND syn AND NOT ack) OR (NOT is_c AND syn AND ack))),
r AS (
  SELECT *,
    sum(is_syn::INT) OVER w AS syn_no,
    last(CASE WHEN is_syn THEN ts END IGNORE NULLS) OVER w AS syn_ts,
    last(CASE WHEN is_syn THEN seq END IGNORE NULLS) OVER w AS syn_seq
  FROM s
  WINDOW w AS (PARTITION BY client_ip, server_ip, client_port, server_port, protocol ORDER BY frame_number
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c AS (
  SELECT *, row_number() OVER (PARTITION BY client_ip, server_ip, client_port, server_port, protocol, syn_no
                               ORDER BY frame_number) AS rn
  FROM r WHERE NOT is_syn AND syn_ts IS NOT NULL AND ackn = syn_seq + 1)
SELECT client_ip, server_ip, client_port, server_port, protocol, frame_number, (ts - syn_ts) * 1000 AS rtt_ms
FROM c WHERE rn = 1""")

oracle("tls_time_to_alert", "WITH " + _ORIENTED.strip() + """,
s AS (
  SELECT client_ip, server_ip, client_port, server_port, protocol, frame_number, timestamp AS ts,
    coalesce(tls_handshake_type <> '', false) AS hs, coalesce(tls_alert_message_description <> '', false) AS al
  FROM op WHERE coalesce(tls_handshake_type <> '', false) OR coalesce(tls_alert_message_description <> '', false)),
g AS (
  SELECT *, coalesce(sum(al::INT) OVER (PARTITION BY client_ip, server_ip, client_port, server_port, protocol
      ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM s),
a AS (
  SELECT client_ip, server_ip, client_port, server_port, protocol, seg,
    arg_min(ts, frame_number) FILTER (WHERE hs) AS start_ts,
    max(ts) FILTER (WHERE al) AS alert_ts, max(frame_number) FILTER (WHERE al) AS frame_number
  FROM g GROUP BY ALL)
SELECT client_ip, server_ip, client_port, server_port, protocol, frame_number, (alert_ts - start_ts) * 1000.0 AS time_to_alert_ms
FROM a WHERE alert_ts IS NOT NULL AND start_ts IS NOT NULL AND alert_ts - start_ts >= 0""")

oracle("rtt_samples", """
WITH t AS (SELECT * FROM packets WHERE upper(protocol) = 'TCP'),
s AS (
  SELECT coalesce(source_ip, '') AS c_ip, coalesce(source_port, 0) AS c_port,
    coalesce(destination_ip, '') AS s_ip, coalesce(destination_port, 0) AS s_port, min(timestamp) AS syn_time
  FROM t WHERE tcp_flags_syn IS TRUE AND tcp_flags_ack IS NOT TRUE GROUP BY ALL),
a AS (
  SELECT coalesce(destination_ip, '') AS c_ip, coalesce(destination_port, 0) AS c_port,
    coalesce(source_ip, '') AS s_ip, coalesce(source_port, 0) AS s_port, min(timestamp) AS synack_time
  FROM t WHERE tcp_flags_syn IS TRUE AND tcp_flags_ack IS TRUE GROUP BY ALL)
SELECT c_ip, c_port, s_ip, s_port, syn_time, synack_time, (synack_time - syn_time) * 1000.0 AS rtt_ms
FROM s JOIN a USING (c_ip, c_port, s_ip, s_port)
WHERE synack_time >= syn_time AND (synack_time - syn_time) * 1000.0 <= 3000.0""")
