"""The packet data model: one wide, columnar table of dissected packets.

Time is float epoch seconds (``DoubleType``) and stays the ordering/arithmetic column;
``frame_number`` is unique within a capture and is the tie-free order. Nulls are real
nulls: no sentinel values unless an operator asks for them (``fill_int_columns``).
"""

from __future__ import annotations

from pyspark.sql import types as T

_STR = T.StringType()
_LONG = T.LongType()
_INT = T.IntegerType()
_BOOL = T.BooleanType()
_DBL = T.DoubleType()
_TS = T.TimestampType()
_STRS = T.ArrayType(T.StringType())

# (name, type) in the order of the packet record.
PACKET_FIELDS: list[tuple[str, T.DataType]] = [
    ("frame_number", _LONG), ("timestamp", _DBL),
    ("source_ip", _STR), ("destination_ip", _STR), ("source_port", _LONG), ("destination_port", _LONG),
    ("protocol", _STR), ("sni", _STR), ("raw_packet_summary", _STR),
    ("source_mac", _STR), ("destination_mac", _STR), ("protocol_l3", _STR),
    ("packet_length", _LONG), ("ip_ttl", _LONG), ("ip_flags_df", _BOOL), ("ip_id", _LONG), ("dscp_value", _LONG),
    ("tcp_flags_syn", _BOOL), ("tcp_flags_ack", _BOOL), ("tcp_flags_fin", _BOOL), ("tcp_flags_rst", _BOOL),
    ("tcp_flags_psh", _BOOL), ("tcp_flags_urg", _BOOL), ("tcp_flags_ece", _BOOL), ("tcp_flags_cwr", _BOOL),
    ("tcp_sequence_number", _LONG), ("tcp_acknowledgment_number", _LONG), ("tcp_window_size", _LONG),
    ("tcp_options_mss", _LONG), ("tcp_options_sack_permitted", _BOOL), ("tcp_options_window_scale", _LONG),
    ("tcp_stream_index", _LONG), ("is_src_client", _BOOL), ("is_source_client", _BOOL),
    ("tcp_analysis_retransmission_flags", _STRS), ("tcp_analysis_duplicate_ack_flags", _STRS),
    ("tcp_analysis_out_of_order_flags", _STRS), ("tcp_analysis_window_flags", _STRS),
    ("dup_ack_num", _LONG), ("adv_window", _LONG), ("tcp_rtt_ms", _DBL), ("tcp_payload_length", _LONG),
    ("tls_handshake_type", _STR), ("tls_handshake_version", _STR), ("tls_record_version", _STR),
    ("tls_cipher_suites_offered", _STRS), ("tls_cipher_suite_selected", _STR),
    ("tls_alert_message_description", _STR), ("tls_alert_level", _STR), ("tls_effective_version", _STR),
    ("tls_cert_subject_cn", _STR), ("tls_cert_san_dns", _STRS), ("tls_cert_san_ip", _STRS),
    ("tls_cert_issuer_cn", _STR), ("tls_cert_serial_number", _STR),
    ("tls_cert_not_before", _TS), ("tls_cert_not_after", _TS), ("tls_cert_sig_alg", _STR),
    ("tls_cert_key_length", _LONG), ("tls_cert_is_self_signed", _BOOL),
    ("dns_query_name", _STR), ("dns_query_type", _STR), ("dns_response_code", _STR),
    ("dns_response_addresses", _STRS), ("dns_response_cname_target", _STR),
    ("http_request_method", _STR), ("http_request_uri", _STR), ("http_request_host_header", _STR),
    ("http_response_code", _LONG), ("http_response_location_header", _STR), ("http_x_forwarded_for_header", _STR),
    ("icmp_type", _LONG), ("icmp_code", _LONG), ("icmp_fragmentation_needed_original_mtu", _LONG),
    ("icmp_original_destination_ip", _STR), ("icmp_original_destination_port", _LONG),
    ("icmp_original_protocol", _STR), ("icmp_original_ip_id", _LONG),
    ("arp_opcode", _LONG), ("arp_sender_mac", _STR), ("arp_sender_ip", _STR),
    ("arp_target_mac", _STR), ("arp_target_ip", _STR),
    ("dhcp_message_type", _STR), ("gre_protocol", _STR), ("esp_spi", _STR),
    ("quic_initial_packet_present", _BOOL), ("is_quic", _BOOL),
    ("is_zscaler_ip", _BOOL), ("is_zpa_synthetic_ip", _BOOL),
    ("ssl_inspection_active", _BOOL), ("zscaler_policy_block_type", _STR),
]

PACKET_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in PACKET_FIELDS])
PACKET_TYPES = dict(PACKET_FIELDS)

# Oriented (client/server) flow key used by every per-flow operator.
FLOW_KEY = ["client_ip", "server_ip", "client_port", "server_port", "protocol"]
# Directional 5-tuple as seen on the wire.
WIRE_KEY = ["source_ip", "destination_ip", "source_port", "destination_port", "protocol"]

# Integer columns and the sentinel the reference substitutes for a missing value (fixed values).
INT_FILL_VALUES = {
    "source_port": -1,
    "destination_port": -1,
    "packet_length": 0,
    "frame_number": -1,
    "tcp_sequence_number": -1,
    "tcp_acknowledgment_number": -1,
    "tcp_window_size": 0,
    "tcp_options_mss": 0,
    "tcp_options_window_scale": 0,
    "icmp_type": -1,
    "icmp_code": -1,
    "ip_ttl": 0,
    "dscp_value": 0,
    "arp_opcode": -1,
    "tcp_stream_index": -1,
    "dup_ack_num": -1,
    "adv_window": 0,
    "icmp_fragmentation_needed_original_mtu": 0,
}
