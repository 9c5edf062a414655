"""Random packet tables with the `packets` view's schema, for differential checks of every
packet query against its DuckDB oracle (nulls, missing directions, odd flags, ties)."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

SCHEMA = pa.schema([
    ("frame_number", pa.int64()), ("timestamp", pa.float64()), ("source_ip", pa.string()),
    ("destination_ip", pa.string()), ("source_port", pa.int64()), ("destination_port", pa.int64()),
    ("protocol", pa.string()), ("packet_length", pa.int64()), ("is_source_client", pa.bool_()),
    ("tcp_flags_syn", pa.bool_()), ("tcp_flags_ack", pa.bool_()), ("tcp_flags_psh", pa.bool_()),
    ("tcp_flags_rst", pa.bool_()), ("tcp_sequence_number", pa.int64()), ("tcp_acknowledgment_number", pa.int64()),
    ("tcp_window_size", pa.int32()), ("tcp_payload_length", pa.int64()), ("ip_id", pa.int64()),
    ("icmp_type", pa.int32()), ("icmp_code", pa.int32()), ("icmp_original_destination_ip", pa.string()),
    ("icmp_original_destination_port", pa.int64()), ("icmp_original_protocol", pa.string()),
    ("icmp_original_ip_id", pa.int32()), ("sni", pa.string()), ("tls_handshake_type", pa.string()),
    ("tls_effective_version", pa.string()), ("tls_alert_message_description", pa.string()),
    ("tls_alert_level", pa.string()), ("tls_cert_is_self_signed", pa.bool_()), ("dns_query_name", pa.string()),
    ("dns_response_code", pa.string()), ("dns_response_addresses_csv", pa.string()),
    ("http_request_method", pa.string()), ("http_request_host_header", pa.string()),
    ("http_request_uri", pa.string()), ("http_response_code", pa.int32()), ("is_quic", pa.bool_()),
])

IPS = ["10.0.0.1", "10.0.0.2", "203.0.113.5", "203.0.113.40", "198.51.100.7", "8.8.8.8", "165.225.1.1",
       "100.64.0.9", "192.0.2.1"]
PORTS = [53, 80, 443, 22, 8080, 40000, 40001, 0]
NAMES = ["a.example", "b.example", "c.example"]


def generate(n: int, seed: int) -> pa.Table:
    rnd = random.Random(seed)
    cols = {f.name: [] for f in SCHEMA}
    t = 1_700_000_000.0
    pending = None
    for i in range(1, n + 1):
        t += rnd.choice([0.0, 0.125, 0.5, 1.0, 3.0, 40.0])
        proto = rnd.choice(["TCP"] * 6 + ["UDP"] * 2 + ["ICMP", "HTTP", None])
        icmp = proto == "ICMP"
        c = cols
        c["frame_number"].append(i)
        c["timestamp"].append(t)
        c["source_ip"].append(rnd.choice(IPS + [None]) if rnd.random() < 0.97 else None)
        c["destination_ip"].append(rnd.choice(IPS))
        c["source_port"].append(None if icmp else rnd.choice(PORTS + [None]))
        c["destination_port"].append(None if icmp else rnd.choice(PORTS))
        c["protocol"].append(proto)
        c["packet_length"].append(rnd.choice([40, 60, 1500, 1300, None]))
        c["is_source_client"].append(rnd.choice([True, True, False, None]))
        tcp = proto == "TCP"
        c["tcp_flags_syn"].append(rnd.random() < 0.3 if tcp else None)
        c["tcp_flags_ack"].append(rnd.random() < 0.6 if tcp else None)
        c["tcp_flags_psh"].append(rnd.random() < 0.3 if tcp else None)
        c["tcp_flags_rst"].append(rnd.random() < 0.1 if tcp else None)
        c["tcp_sequence_number"].append(rnd.choice([0, 100, 200, 101, None]) if tcp else None)
        c["tcp_acknowledgment_number"].append(rnd.choice([1, 101, 201, None]) if tcp else None)
        c["tcp_window_size"].append(rnd.choice([0, 65535, None]) if tcp else None)
        c["tcp_payload_length"].append(rnd.choice([0, 0, 100, None]) if tcp else None)
        c["ip_id"].append(None if icmp else rnd.choice([1, 2, 3, None]))
        c["icmp_type"].append(rnd.choice([3, 11, 0, 8]) if icmp else None)
        c["icmp_code"].append(rnd.choice([0, 1, 3, 4]) if icmp else None)
        c["icmp_original_destination_ip"].append(rnd.choice(IPS) if icmp else None)
        c["icmp_original_destination_port"].append(rnd.choice(PORTS) if icmp else None)
        c["icmp_original_protocol"].append(rnd.choice(["TCP", "UDP", "", None]) if icmp else None)
        c["icmp_original_ip_id"].append(rnd.choice([1, 2, 3, None]) if icmp else None)
        tls = tcp and rnd.random() < 0.3
        c["sni"].append(rnd.choice(NAMES) if tls and rnd.random() < 0.6 else None)
        c["tls_handshake_type"].append(rnd.choice(["ClientHello", "ServerHello", "Finished", None]) if tls else None)
        c["tls_effective_version"].append(rnd.choice(["TLS 1.0", "TLS 1.1", "TLS 1.2", ""]) if tls else None)
        c["tls_alert_message_description"].append(rnd.choice(["handshake_failure", None, None]) if tls else None)
        c["tls_alert_level"].append(rnd.choice(["fatal", "warning", None]) if tls else None)
        c["tls_cert_is_self_signed"].append(rnd.choice([True, False, None]) if tls else None)
        dns = rnd.random() < 0.15
        c["dns_query_name"].append(rnd.choice(NAMES) if dns else None)
        c["dns_response_code"].append(rnd.choice(["NOERROR", "NXDOMAIN", "SERVFAIL", None]) if dns else None)
        c["dns_response_addresses_csv"].append(
            rnd.choice(["203.0.113.5", "203.0.113.5,198.51.100.7", "8.8.8.8", "", None]) if dns else None)
        http = rnd.random() < 0.1
        c["http_request_method"].append(rnd.choice(["GET", "POST", "CONNECT", ""]) if http else None)
        c["http_request_host_header"].append(rnd.choice(NAMES) if http else None)
        c["http_request_uri"].append("/x" if http else None)
        c["http_response_code"].append(rnd.choice([200, 407, None]) if http else None)
        c["is_quic"].append(rnd.choice([True, False]) if proto == "UDP" else False)
        # Correlated rows: a client resolves a name, then opens TLS to an answer (or elsewhere).
        r = rnd.random()
        if r < 0.12:
            _overwrite(c, src=rnd.choice(CLIENTS), dst="8.8.8.8", sport=rnd.choice([40000, 40001]), dport=53,
                       proto="UDP", name=rnd.choice(NAMES), answers=rnd.choice(ANSWERS), client=True)
        elif r < 0.24:
            _overwrite(c, src=rnd.choice(CLIENTS), dst=rnd.choice(["203.0.113.5", "198.51.100.7", "203.0.113.40"]),
                       sport=rnd.choice([40000, 40001]), dport=443, proto="TCP", sni=rnd.choice(NAMES), client=True)
        elif pending is not None:
            # SYN-ACK answering the previous SYN (sometimes acknowledging the wrong number).
            src, dst, sport, dport, seq = pending
            _overwrite(c, src=dst, dst=src, sport=dport, dport=sport, proto="TCP", client=False)
            _flags(c, syn=True, ack=True, seq=500, ackn=rnd.choice([seq + 1, seq + 1, seq + 7]))
            pending = None
            continue
        elif r < 0.32:
            src, dst = rnd.choice(CLIENTS), rnd.choice(["203.0.113.5", "198.51.100.7"])
            sport, seq = rnd.choice([40002, 40003]), rnd.choice([100, 200])
            _overwrite(c, src=src, dst=dst, sport=sport, dport=443, proto="TCP", client=True)
            _flags(c, syn=True, ack=False, seq=seq, ackn=None)
            pending = (src, dst, sport, 443, seq)
            continue
        pending = None
    return pa.table(cols, schema=SCHEMA)


def _flags(c, syn, ack, seq, ackn):
    c["tcp_flags_syn"][-1], c["tcp_flags_ack"][-1] = syn, ack
    c["tcp_flags_psh"][-1], c["tcp_flags_rst"][-1] = False, False
    c["tcp_sequence_number"][-1], c["tcp_acknowledgment_number"][-1] = seq, ackn


CLIENTS = ["10.0.0.1", "10.0.0.2"]
ANSWERS = ["203.0.113.5", "203.0.113.5,198.51.100.7", "198.51.100.7", ""]


def _overwrite(c, src, dst, sport, dport, proto, client, name=None, answers=None, sni=None):
    """Turn the last generated row into a DNS query or a TLS row (other fields kept)."""
    c["source_ip"][-1], c["destination_ip"][-1] = src, dst
    c["source_port"][-1], c["destination_port"][-1], c["protocol"][-1] = sport, dport, proto
    c["is_source_client"][-1] = client
    if name is not None:
        c["dns_query_name"][-1], c["dns_response_addresses_csv"][-1] = name, answers
    if sni is not None:
        c["sni"][-1] = sni
        c["tls_handshake_type"][-1] = "ClientHello"


def write(path: str, n: int, seed: int) -> None:
    pq.write_table(generate(n, seed), path)
