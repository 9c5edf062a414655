"""Inputs shared by operators and oracles: the ``packets`` view over the driver's ``events``.

The SQL text below is the only thing the Spark side and the DuckDB oracle have in common. Each
block of ten events is one conversation (``kind = c % 8``: DNS, SSH refused by RST, TLS ok, TLS
fatal alert, HTTP 80, HTTP proxy 407, SYN with downstream ICMP errors, QUIC).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS_VIEW_SQL = """
WITH e AS (
  SELECT event_id, value, event_id % 10 AS i,
         CAST((event_id - event_id % 10) / 10 AS BIGINT) AS c FROM events),
k AS (
  SELECT *, c % 8 AS kind, CAST((c - c % 8) / 8 AS BIGINT) AS g,
         CASE WHEN i IN (1, 4, 6, 8) THEN FALSE ELSE TRUE END AS is_c FROM e),
p AS (
  SELECT *,
    '10.1.' || CAST(CAST((g - g % 250) / 250 AS BIGINT) % 250 AS STRING) || '.' || CAST(g % 250 AS STRING) AS cip,
    CASE WHEN kind = 0 THEN '8.8.8.8'
         WHEN kind = 1 THEN '165.225.3.' || CAST(g % 250 AS STRING)
         WHEN kind = 2 THEN '203.0.113.' || CAST(g % 50 AS STRING)
         WHEN kind = 3 THEN CASE WHEN g % 3 = 0 THEN '192.0.2.99' ELSE '203.0.113.' || CAST(g % 50 AS STRING) END
         WHEN kind = 4 THEN '100.64.0.' || CAST(g % 250 AS STRING)
         ELSE '198.51.100.' || CAST(g % 250 AS STRING) END AS sip,
    CAST(20000 + kind * 1000 + g % 1000 AS BIGINT) AS cport,
    CAST(CASE kind WHEN 0 THEN 53 WHEN 1 THEN 22 WHEN 2 THEN 443 WHEN 3 THEN 443 WHEN 4 THEN 80
              WHEN 5 THEN 8080 WHEN 6 THEN 80 ELSE 443 END AS BIGINT) AS sport,
    CASE WHEN kind IN (0, 7) THEN 'UDP' ELSE 'TCP' END AS l4,
    CASE WHEN kind = 6 AND i >= 7 THEN TRUE ELSE FALSE END AS is_icmp,
    1704067200 + (g % 400) * 8 + kind * 0.5 + i * 0.125 AS ts,
    'host' || CAST(g % 50 AS STRING) || '.example.com' AS host FROM k)
SELECT
  event_id + 1 AS frame_number, CAST(ts AS DOUBLE) AS timestamp,
  CASE WHEN is_icmp THEN '9.9.9.9' WHEN is_c THEN cip ELSE sip END AS source_ip,
  CASE WHEN is_icmp THEN cip WHEN is_c THEN sip ELSE cip END AS destination_ip,
  CASE WHEN is_icmp THEN 0 WHEN is_c THEN cport ELSE sport END AS source_port,
  CASE WHEN is_icmp THEN 0 WHEN is_c THEN sport ELSE cport END AS destination_port,
  CASE WHEN is_icmp THEN 'ICMP' ELSE l4 END AS protocol,
  CAST(floor(value) AS BIGINT) + 40 + CASE WHEN g % 97 = 5 AND i = 5 THEN 20000 ELSE 0 END AS packet_length,
  CASE WHEN is_icmp THEN FALSE ELSE is_c END AS is_source_client,
  (l4 = 'TCP' AND NOT is_icmp AND i IN (0, 1)) AS tcp_flags_syn,
  (l4 = 'TCP' AND NOT is_icmp AND i > 0) AS tcp_flags_ack,
  (l4 = 'TCP' AND NOT is_icmp AND i >= 3 AND kind NOT IN (1, 6)) AS tcp_flags_psh,
  (kind = 1 AND i = 4) AS tcp_flags_rst,
  CASE WHEN l4 = 'TCP' AND NOT is_icmp THEN CASE WHEN i = 7 THEN 500 ELSE i * 100 END END AS tcp_sequence_number,
  CASE WHEN l4 = 'TCP' AND NOT is_icmp AND i > 0 THEN CASE WHEN i = 1 THEN 1 ELSE (i - 1) * 100 END END AS tcp_acknowledgment_number,
  CASE WHEN l4 = 'TCP' AND NOT is_icmp THEN CASE WHEN i = 8 THEN 0 ELSE 65535 END END AS tcp_window_size,
  CASE WHEN NOT is_icmp THEN CASE WHEN l4 = 'TCP' AND i < 3 THEN 0 ELSE CAST(floor(value) AS BIGINT) END END AS tcp_payload_length,
  CAST(CASE WHEN is_icmp THEN NULL ELSE i END AS BIGINT) AS ip_id,
  CASE WHEN is_icmp THEN 11 END AS icmp_type, CASE WHEN is_icmp THEN 0 END AS icmp_code,
  CASE WHEN is_icmp THEN sip END AS icmp_original_destination_ip,
  CASE WHEN is_icmp THEN sport END AS icmp_original_destination_port,
  CASE WHEN is_icmp THEN 'TCP' END AS icmp_original_protocol,
  CASE WHEN is_icmp THEN CASE WHEN i = 7 THEN 0 WHEN i = 8 THEN 2 ELSE 77 END END AS icmp_original_ip_id,
  CASE WHEN kind IN (2, 3) AND i = 3 THEN host END AS sni,
  CASE WHEN kind IN (2, 3) AND i = 3 THEN 'ClientHello' WHEN kind = 2 AND i = 4 THEN 'ServerHello' END AS tls_handshake_type,
  CASE WHEN kind IN (2, 3) AND i IN (3, 4) THEN CASE g % 4 WHEN 0 THEN 'TLS 1.0' WHEN 1 THEN 'TLS 1.1' WHEN 2 THEN 'TLS 1.2' ELSE 'TLS 1.3' END END AS tls_effective_version,
  CASE WHEN kind = 3 AND i = 4 THEN 'handshake_failure' END AS tls_alert_message_description,
  CASE WHEN kind = 3 AND i = 4 THEN 'fatal' END AS tls_alert_level,
  CASE WHEN kind = 2 AND i = 4 THEN g % 5 = 0 END AS tls_cert_is_self_signed,
  CASE WHEN kind = 0 THEN host END AS dns_query_name,
  CASE WHEN kind = 0 AND NOT is_c THEN CASE WHEN g % 7 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END END AS dns_response_code,
  CASE WHEN kind = 0 THEN '203.0.113.' || CAST(g % 50 AS STRING) END AS dns_response_addresses_csv,
  CASE WHEN kind IN (4, 5) AND i = 3 THEN CASE WHEN kind = 5 THEN 'CONNECT' WHEN g % 2 = 0 THEN 'POST' ELSE 'GET' END END AS http_request_method,
  CASE WHEN kind = 4 AND i = 3 THEN host END AS http_request_host_header,
  CASE WHEN kind = 4 AND i = 3 THEN '/p' || CAST(g % 9 AS STRING) END AS http_request_uri,
  CASE WHEN kind = 5 AND i = 4 THEN 407 WHEN kind = 4 AND i = 4 THEN 200 END AS http_response_code,
  (kind = 7) AS is_quic
FROM p
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


PACKETS_PATH_CONF = "netflow.packets.path"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``packets`` view over ``{sf_dir}/events.parquet`` (lazy; one projection over the scan).

    When the session sets ``netflow.packets.path``, the packets are read from that stored
    Parquet table instead (the same rows, written once by ``store_packets``)."""
    stored = spark.conf.get(PACKETS_PATH_CONF, None)
    if stored:
        return spark.read.parquet(stored)
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(PACKETS_VIEW_SQL)


def store_packets(spark: SparkSession, sf_dir: str, path: str, files: int | None = None) -> None:
    """Write the ``packets`` view once as a Parquet table (what an ingest job would produce):
    files range-partitioned by frame number, so frame-range filters skip files and row groups."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    n = files or spark.sparkContext.defaultParallelism
    (spark.sql(PACKETS_VIEW_SQL).repartitionByRange(n, "frame_number").sortWithinPartitions("frame_number")
     .write.mode("overwrite").parquet(path))


def oracle_with_packets(body_sql: str) -> str:
    """Prefix an oracle query with the shared ``packets`` CTE (DuckDB side)."""
    body = body_sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH packets AS (" + PACKETS_VIEW_SQL + "),\n" + body[5:]
    return "WITH packets AS (" + PACKETS_VIEW_SQL + ")\n" + body


# Test dimension (invented values): network, index into ``nation`` (for the country name), ISO code,
# city, coordinates, AS number and organisation.
DEMO_NETWORKS = [
    ("203.0.113.0/24", 0, "US", "Springfield", 39.78, -89.65, 64500, "Example Transit"),
    ("203.0.113.0/26", 1, "DE", "Musterstadt", 50.11, 8.68, 64501, "Muster Hosting"),
    ("203.0.113.32/27", 2, "IR", "Tehran", 35.69, 51.39, 64502, "Persia Net"),
    ("198.51.100.0/24", 3, "GB", "London", 51.51, -0.13, 64503, "Albion Cloud"),
    ("8.8.8.0/24", 4, "US", "Mountain View", 37.39, -122.08, 64504, "Resolver Org"),
    ("165.225.0.0/17", 5, "CN", "Shanghai", 31.23, 121.47, 64505, "Edge Proxy"),
    ("100.64.0.0/10", 6, "NL", "Amsterdam", 52.37, 4.90, 64506, "Carrier NAT"),
    ("10.1.0.0/16", 7, "FR", "Paris", 48.86, 2.35, 64507, "Campus LAN"),
    ("9.9.9.0/24", 8, "BR", "Sao Paulo", -23.55, -46.63, 64508, "Quad Resolver"),
    ("192.0.2.0/24", 9, "RU", "Moscow", 55.76, 37.62, 64509, "Doc Range"),
    ("2001:db8::/32", 10, "US", "Sixville", 40.0, -90.0, 64510, "Six Transit"),
    ("2001:db8:cb00::/48", 11, "DE", "Sechsdorf", 51.0, 9.0, 64511, "Sechs Hosting"),
    ("2001:db8:cb00:7100::/59", 12, "IR", "Shesh", 36.0, 52.0, 64512, "Shesh Net"),
    ("2001:db8:808::/47", 13, "GB", "Sixford", 52.0, -1.0, 64513, "Six Cloud"),
]


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.enrich import networks_table
    return networks_table(spark, DEMO_NETWORKS, table(spark, sf_dir, "nation"))


# IPv6 counterparts of the view's addresses: a.b.c.d is also seen as 2001:db8:<ab>:<cd>::1.
ADDRESSES_SQL = """
SELECT destination_ip AS ip FROM packets
UNION ALL
SELECT '2001:db8:' || lower(hex(CAST(split_part(destination_ip, '.', 1) AS BIGINT) * 256 + CAST(split_part(destination_ip, '.', 2) AS BIGINT)))
  || ':' || lower(hex(CAST(split_part(destination_ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(destination_ip, '.', 4) AS BIGINT))) || '::1'
FROM packets
"""


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 destinations of the packets and an IPv6 counterpart of each."""
    packets(spark, sf_dir).createOrReplaceTempView("packets")
    return spark.sql(ADDRESSES_SQL)


def two_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures in one table with overlapping frames and seconds: the view, and three of its
    four quarters with other lengths."""
    p = packets(spark, sf_dir)
    second = p.where("frame_number % 40 < 30").withColumn("packet_length", F.expr("packet_length + frame_number % 7"))
    return p.withColumn("capture_id", F.lit("a")).unionByName(second.withColumn("capture_id", F.lit("b")))


def http_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets with dissected HTTP rows named ``HTTP`` instead of ``TCP``, so that R2 can fire."""
    http = "http_request_method IS NOT NULL OR http_response_code IS NOT NULL"
    return packets(spark, sf_dir).withColumn("protocol", F.expr(f"CASE WHEN {http} THEN 'HTTP' ELSE protocol END"))
