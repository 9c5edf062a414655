"""Registered rule-language queries: one per rule operator (F1–F22) and per default-pack group
(F24), plus the L7 filter (F25). The rule engine takes any table, so the operator queries run
over the driver's TPC-style tables as well as over packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import packets, table
from ..functions.classify import packet_error_reason
from ..functions.net import vendor_ip_flags
from ..rules import default_rules, tag
from .registry import query


def rule_input(spark: SparkSession, sf: str) -> DataFrame:
    """Packets with the columns the parser would attach: vendor address flags, answer list,
    packet error reason."""
    p = packets(spark, sf)
    p = vendor_ip_flags(p).withColumn("dns_response_addresses", F.split("dns_response_addresses_csv", ","))
    p = p.withColumn("packet_error_reason", packet_error_reason(p))
    # The row count keeps the view's wide projection and the rule pack's in stages of their own: as
    # one, their generated code exceeds the JVM's method size and Spark falls back to interpreting.
    return p.observe("rule_input", F.count(F.lit(1)).alias("rows"))


def _one(rules: list[dict], default="DEFAULT") -> dict:
    return {"target_column_map": {"rules": "result"}, "default_values": {"result": default}, "rules": rules}


def _r(name, out, conds=None, any_=None, stop=False, fmt=None) -> dict:
    r = {"name": name, "stop_processing": stop}
    if out is not None:
        r["output_value"] = out
    if fmt is not None:
        r["output_value_format"] = fmt
    if conds is not None:
        r["conditions"] = conds
    if any_ is not None:
        r["conditions_any"] = any_
    return r


def _c(field, op, value=None) -> dict:
    d = {"field": field, "operator": op}
    if value is not None:
        d["value"] = value
    return d


RULE_PACKS: dict[str, tuple[str, str, dict]] = {
    # key: (table, id column, pack)
    "rules_equals": ("orders", "o_orderkey", _one([
        _r("urgent", "URGENT", [_c("o_orderpriority", "equals", "1-URGENT")], stop=True),
        _r("filled", "FILLED", [_c("o_orderstatus", "equals", "F")]),
        _r("text vs number", "NEVER", [_c("o_custkey", "equals", "5")]),
        _r("cust7", "CUST7", [_c("o_custkey", "equals", 7)]),
    ])),
    "rules_not_equals": ("packets", "frame_number", _one([
        _r("not host1", "NOT_HOST1", [_c("sni", "not_equals", "host1.example.com")], stop=True),
        _r("not tcp", "NOT_TCP", [_c("protocol", "not_equals", "TCP")]),
    ])),
    "rules_in": ("packets", "frame_number", _one([
        _r("web", "WEB", [_c("destination_port", "in", [80, 443])]),
        _r("udp", "UDP", [_c("protocol", "in", ["UDP"])], stop=True),
        _r("dns error", "DNSERR", [_c("dns_response_code", "in", ["NXDOMAIN", "SERVFAIL"])]),
    ])),
    "rules_not_in": ("packets", "frame_number", _one([
        _r("other sni", "OTHER_SNI", [_c("sni", "not_in", ["host1.example.com", "host2.example.com"])]),
        _r("not web", "NOT_WEB", [_c("destination_port", "not_in", [80, 443, "53"])], stop=True),
    ])),
    "rules_regex": ("customer", "c_custkey", _one([
        _r("name", "MATCH", [_c("c_name", "regex", "(?i)CUSTOMER#00000001")]),
        _r("segment", "SEG", [_c("c_mktsegment", "regex", "^MACH|^AUTO")]),
    ])),
    "rules_not_regex": ("packets", "frame_number", _one([
        _r("sni not host1x", "NOMATCH", [_c("sni", "not_regex", r"host1\d\.")]),
    ])),
    "rules_cidr": ("packets", "frame_number", _one([
        _r("low clients", "LOCAL_LOW", [_c("source_ip", "cidr", "10.1.0.0/25")]),
        _r("doc net", "DST_NET", [_c("destination_ip", "cidr", "203.0.113.5/28")], stop=True),
        _r("bad net", "BAD", [_c("destination_ip", "cidr", "not-a-network")]),
    ])),
    "rules_not_cidr": ("packets", "frame_number", _one([
        _r("not doc", "NOT_DOC_NET", [_c("destination_ip", "not_cidr", "203.0.113.0/24")]),
    ])),
    "rules_gt": ("orders", "o_orderkey", _one([
        _r("big", "BIG", [_c("o_totalprice", "gt", 300000)]),
        _r("text", "NEVER", [_c("o_orderstatus", "gt", 1)]),
    ])),
    "rules_lt": ("orders", "o_orderkey", _one([
        _r("small", "SMALL", [_c("o_totalprice", "lt", 50000.5)]),
        _r("low key", "LOWKEY", [_c("o_custkey", "lt", 10)], stop=True),
    ])),
    "rules_gte": ("packets", "frame_number", _one([
        _r("large", "LARGE", [_c("packet_length", "gte", 500)]),
        _r("sni number", "NEVER", [_c("sni", "gte", 1)]),
    ])),
    "rules_lte": ("packets", "frame_number", _one([
        _r("tiny", "TINY", [_c("packet_length", "lte", 45)]),
        _r("bool", "SYN", [_c("tcp_flags_syn", "lte", 1), _c("tcp_flags_syn", "gte", True)]),
    ])),
    "rules_exists": ("packets", "frame_number", _one([
        _r("has sni", "HAS_SNI", [_c("sni", "exists")]),
        _r("missing column", "NEVER", [_c("no_such_column", "exists")]),
    ])),
    "rules_not_exists": ("packets", "frame_number", _one([
        _r("no method", "NO_METHOD", [_c("http_request_method", "not_exists")]),
        _r("missing column", "NEVER", [_c("no_such_column", "not_exists")]),
    ])),
    "rules_starts_with": ("packets", "frame_number", _one([
        _r("host1", "HOST1", [_c("dns_query_name", "starts_with", "host1")]),
        _r("port 44x", "PORT44", [_c("destination_port", "starts_with", "44")]),
    ])),
    "rules_ends_with": ("packets", "frame_number", _one([
        _r("sni 3", "SNI3", [_c("sni", "ends_with", "3.example.com")]),
        _r("bool text", "CLIENT", [_c("is_source_client", "ends_with", "ue")], stop=True),
    ])),
    "rules_conditions": ("packets", "frame_number", _one([
        _r("empty and", "ALL", []),
        _r("tcp to or from 443", "TLS_PORT", [_c("protocol", "equals", "TCP")],
           [_c("destination_port", "equals", 443), _c("source_port", "equals", 443)]),
        _r("empty or", "NEVER", None, []),
        _r("app evidence", "APP", None, [_c("sni", "exists"), _c("http_request_method", "exists")]),
    ])),
    "rules_unknown": ("packets", "frame_number", _one([
        _r("unknown column", "A", [_c("no_such_column", "equals", "x")]),
        _r("unknown operator", "B", [_c("protocol", "bogus", "TCP")]),
        _r("missing operator", "C", [{"field": "protocol", "value": "TCP"}]),
        _r("contains is not an operator", "D", [_c("protocol", "contains", "TC")]),
        _r("udp", "UDP", [_c("protocol", "equals", "UDP")]),
    ])),
    "rules_stop": ("packets", "frame_number", _one([
        _r("tcp", "TCP", [_c("protocol", "equals", "TCP")]),
        _r("syn locks", None, [_c("tcp_flags_syn", "equals", True)], stop=True),
        _r("https", "HTTPS", [_c("destination_port", "equals", 443)]),
        _r("udp", "UDP", [_c("protocol", "equals", "UDP")], stop=True),
        _r("sni", "SNI", [_c("sni", "exists")]),
    ])),
    "rules_format": ("packets", "frame_number", _one([
        _r("port", None, [_c("destination_port", "equals", 443)], fmt="{protocol}:{destination_port} sni={sni}"),
        _r("missing placeholder", None, [_c("protocol", "equals", "UDP")], fmt="{protocol}-{nope}"),
        _r("no placeholder", None, [_c("dns_query_name", "exists")], fmt="plain"),
        _r("bool", None, [_c("http_request_method", "exists")], fmt="client={is_source_client} m={http_request_method}"),
    ])),
}


def _rule_query(key: str):
    tbl, idc, pack = RULE_PACKS[key]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = packets(spark, sf) if tbl == "packets" else table(spark, sf, tbl)
        return tag(df, pack).select(idc, "result")
    return run


for _k in RULE_PACKS:
    query(_k)(_rule_query(_k))


DEFAULTS_PACK = {
    "target_column_map": {"first": "kind1", "second": "kind2", "third": "flag"},
    "default_values": {"kind2": "base", "flag": False},
    "first": [_r("udp", "udp", [_c("protocol", "equals", "UDP")])],
    "second": [_r("reads earlier target", "from_t1", [_c("kind1", "equals", "udp")])],
    "third": [_r("sni", True, [_c("sni", "exists")])],
}


@query("rules_defaults")
def q_rules_defaults(spark: SparkSession, sf: str) -> DataFrame:
    return tag(packets(spark, sf), DEFAULTS_PACK).select("frame_number", "kind1", "kind2", "flag", "flow_outcome")


OUTCOME_PACK = {
    "target_column_map": {"dummy_rules": "dummy"},
    "default_values": {"dummy": "", "flow_outcome": "Analyzed"},
    "dummy_rules": [],
    "flow_outcome_rules": [
        {"name": "nx", "value": "NX", "conditions": [_c("dns_response_code", "equals", "NXDOMAIN")]},
        {"name": "tcp", "value": "TCP", "conditions": [_c("protocol", "equals", "TCP")]},
        {"name": "bad", "value": "BAD", "conditions": "oops"},
        {"name": "never reached", "value": "X", "conditions": [_c("protocol", "equals", "UDP")]},
    ],
}


@query("rules_flow_outcome")
def q_rules_flow_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return tag(packets(spark, sf), OUTCOME_PACK).select("frame_number", "dummy", "flow_outcome")


# Default pack over packets with parser-derived columns.
PACK_GROUPS = {
    "rules_disposition": ["flow_disposition"],
    "rules_traffic_type": ["traffic_type_guess"],
    "rules_observation": ["security_observation"],
    "rules_vendor": ["zscaler_specific_finding"],
    "rules_errors": ["flow_error_type", "flow_error_details"],
    "rules_flags": ["security_flag_plaintext_http", "security_flag_outdated_tls_version",
                    "security_flag_self_signed_cert"],
}


def _pack_query(cols: list[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return tag(rule_input(spark, sf), default_rules()).select("frame_number", *cols)
    return run


for _k, _cols in PACK_GROUPS.items():
    query(_k)(_pack_query(_cols))
