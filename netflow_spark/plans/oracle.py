"""DuckDB oracle SQL, one per registered query.

Written independently of the Spark operators; the only shared text is the ``packets`` view
(prefixed as a CTE). Column names match the Spark side exactly.
"""

from __future__ import annotations

from ..fixtures import oracle_with_packets

ORACLE: dict[str, str] = {}
RAW: dict[str, str] = {}


def oracle(name: str, sql: str, packets: bool = True) -> None:
    RAW[name] = sql.strip()
    ORACLE[name] = oracle_with_packets(sql) if packets else sql.strip()


def nested(name: str) -> str:
    """Body of an earlier oracle, usable as a CTE (it may contain its own WITH)."""
    return "(" + RAW[name] + ")"


# Oriented packets: a null direction reads server→client.
_ORIENTED = """
op AS (
  SELECT *,
    CASE WHEN is_source_client THEN source_ip ELSE destination_ip END AS client_ip,
    CASE WHEN is_source_client THEN destination_ip ELSE source_ip END AS server_ip,
    CASE WHEN is_source_client THEN source_port ELSE destination_port END AS client_port,
    CASE WHEN is_source_client THEN destination_port ELSE source_port END AS server_port,
    is_source_client IS TRUE AS is_c, is_source_client IS FALSE AS is_s,
    coalesce(tcp_flags_syn, false) AS syn, coalesce(tcp_flags_ack, false) AS ack,
    coalesce(tcp_flags_psh, false) AS psh, coalesce(tcp_flags_rst, false) AS rst
  FROM packets)"""

_SIGNALS = _ORIENTED + """,
sig AS (
  SELECT client_ip, server_ip, client_port, server_port, protocol,
    min(timestamp) FILTER (WHERE is_c AND syn AND NOT ack) AS first_syn_time,
    coalesce(bool_or(is_s AND syn AND ack), false) AS synack_seen,
    coalesce(bool_or(is_c AND ack AND NOT syn), false) AS ack_seen,
    coalesce(bool_or(is_c AND psh), false) AS data_c,
    coalesce(bool_or(is_s AND psh), false) AS data_s,
    min(timestamp) FILTER (WHERE is_s AND rst) AS first_rst_time,
    coalesce(bool_or(upper(protocol) IN ('ICMP', 'ICMPV6') AND icmp_type IN (3, 11)), false) AS icmp_error,
    min(timestamp) FILTER (WHERE is_c AND tls_handshake_type = 'ClientHello') AS first_client_hello_time,
    min(timestamp) FILTER (WHERE is_s AND tls_handshake_type = 'ServerHello') AS first_server_hello_time,
    min(timestamp) FILTER (WHERE tls_alert_message_description IS NOT NULL OR rst) AS first_alert_time
  FROM op
  WHERE client_ip IS NOT NULL AND server_ip IS NOT NULL AND client_port IS NOT NULL
    AND server_port IS NOT NULL AND protocol IS NOT NULL
  GROUP BY client_ip, server_ip, client_port, server_port, protocol),
flows AS (
  SELECT client_ip, server_ip, client_port, server_port, protocol,
    (first_syn_time IS NOT NULL AND synack_seen AND ack_seen) AS handshake_complete,
    (data_c AND data_s) AS data_both,
    coalesce(first_rst_time - first_syn_time <= 2, false) AS rst_after_syn,
    icmp_error, first_syn_time, first_rst_time, first_client_hello_time, first_server_hello_time,
    CASE WHEN first_client_hello_time IS NULL THEN NULL
         ELSE first_server_hello_time IS NOT NULL
              AND (first_alert_time IS NULL OR first_server_hello_time <= first_alert_time)
              AND first_server_hello_time - first_client_hello_time <= 5 END AS tls_handshake_ok,
    first_alert_time,
    first_alert_time - first_client_hello_time AS time_to_alert
  FROM sig)"""

_ICMP = """,
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
matched AS (
  SELECT e.e_frame, arg_max(struct_pack(client_ip := c.client_ip, server_ip := c.server_ip,
         client_port := c.client_port, server_port := c.server_port, protocol := c.protocol), c.c_frame) AS f
  FROM errs e JOIN cands c
    ON c.q_ip IS NOT DISTINCT FROM e.q_ip AND c.q_port IS NOT DISTINCT FROM e.q_port
   AND c.q_proto IS NOT DISTINCT FROM e.q_proto AND c.q_ipid IS NOT DISTINCT FROM e.q_ipid
   AND c.c_frame < e.e_frame
  GROUP BY e.e_frame),
icmp_counts AS (
  SELECT f.client_ip AS client_ip, f.server_ip AS server_ip, f.client_port AS client_port,
         f.server_port AS server_port, f.protocol AS protocol, count(*) AS icmp_error_count
  FROM matched GROUP BY ALL)"""

_TAGGED = _SIGNALS + _ICMP + """,
casc AS (
  SELECT f.*, coalesce(ic.icmp_error_count, 0) AS icmp_error_count,
    CASE WHEN handshake_complete AND data_both THEN 'Allowed'
         WHEN rst_after_syn THEN 'Blocked'
         WHEN icmp_error THEN 'Degraded'
         ELSE 'Unknown' END AS d0,
    CASE WHEN handshake_complete AND data_both THEN 'Completed TCP session with data exchange'
         WHEN rst_after_syn THEN 'TCP RST from destination after SYN'
         WHEN icmp_error THEN 'ICMP Destination Unreachable/Time Exceeded in flow'
         ELSE 'Undetermined' END AS c0
  FROM flows f LEFT JOIN icmp_counts ic USING (client_ip, server_ip, client_port, server_port, protocol)),
tls AS (
  SELECT *,
    CASE WHEN tls_handshake_ok IS FALSE THEN 'Blocked' ELSE d0 END AS d1,
    CASE WHEN tls_handshake_ok IS FALSE THEN 'TLS Handshake Failure' ELSE c0 END AS c1
  FROM casc),
tagged AS (
  SELECT (dense_rank() OVER (ORDER BY client_ip, server_ip, client_port, server_port, protocol) - 1)::BIGINT AS flow_id,
    client_ip, server_ip, client_port, server_port, protocol,
    CASE WHEN icmp_error_count > 0 AND d1 IN ('', 'Unknown') THEN 'Degraded' ELSE d1 END AS flow_disposition,
    CASE WHEN icmp_error_count > 0 AND d1 IN ('', 'Unknown') THEN 'Downstream ICMP errors' ELSE c1 END AS flow_cause,
    icmp_error_count, tls_handshake_ok, first_alert_time, time_to_alert,
    handshake_complete, data_both, rst_after_syn, icmp_error, first_syn_time, first_rst_time
  FROM tls)"""

oracle("tag_flows", "WITH " + _TAGGED + """
SELECT flow_id, client_ip, server_ip, client_port, server_port, protocol, flow_disposition, flow_cause,
       icmp_error_count, tls_handshake_ok, first_alert_time, time_to_alert
FROM tagged""")


from . import oracle_rules  # noqa: E402,F401  (registers rule oracles)
from . import oracle_flows  # noqa: E402,F401
from . import oracle_metrics  # noqa: E402,F401
