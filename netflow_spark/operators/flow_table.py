"""Per-flow tables over oriented packets.

* ``flow_table`` — bytes/packets per direction and start/end: one ``groupBy`` with conditional
  sums (partial aggregation absorbs elephant flows).
* ``flow_sparklines`` — per-second byte bins, zero-filled from start to end second: an aggregate
  per (flow, second) and the gap to the flow's next second; the per-flow list is bounded by the
  seconds in which it has packets.
* ``flow_summary`` — the 22-column summary with priority picks (``min_by`` with rank structs).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import guess_l7
from ..functions.columns import direction, first_present, opt

TABLE_KEY = ["src_ip", "dest_ip", "src_port", "dest_port", "protocol"]


def _table_key(df: DataFrame) -> dict[str, Column]:
    """Oriented key with the flow table's defaults (missing ip/proto → "", port → 0); a null
    direction reads server→client."""
    o = F.coalesce(direction(df), F.lit(False))
    sip = F.coalesce(F.col("source_ip"), F.lit(""))
    dip = F.coalesce(F.col("destination_ip"), F.lit(""))
    sp = F.coalesce(F.col("source_port").try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    dp = F.coalesce(F.col("destination_port").try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    return {"src_ip": F.when(o, sip).otherwise(dip), "dest_ip": F.when(o, dip).otherwise(sip),
            "src_port": F.when(o, sp).otherwise(dp), "dest_port": F.when(o, dp).otherwise(sp),
            "protocol": F.coalesce(F.col("protocol"), F.lit("")), "_c2s": o,
            "_len": F.coalesce(F.col("packet_length").try_cast("double").try_cast("long"), F.lit(0).cast("long")),
            "_ts": F.col("timestamp").cast("double")}


def keyed(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    cols = _table_key(packets)
    return packets.select(*keys, *[v.alias(k) for k, v in cols.items()])


def table_from_facts(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """G5 from flow facts: null key parts read ""/0, so the raw-key groups that coincide after
    that substitution are merged by a second, per-flow-sized aggregate (no packet shuffle). Packets
    without a timestamp count but set no time; a flow without any timestamp starts and ends at 0."""
    keys = list(keys)
    k = facts.select(
        *keys, F.coalesce(F.col("client_ip"), F.lit("")).alias("src_ip"),
        F.coalesce(F.col("server_ip"), F.lit("")).alias("dest_ip"),
        F.coalesce(F.col("client_port").try_cast("double").try_cast("long"), F.lit(0).cast("long")).alias("src_port"),
        F.coalesce(F.col("server_port").try_cast("double").try_cast("long"), F.lit(0).cast("long")).alias("dest_port"),
        F.coalesce(F.col("protocol"), F.lit("")).alias("protocol"),
        "bytes_c2s", "bytes_s2c", "pkts_c2s", "pkts_s2c", "start_ts", "end_ts")
    agg = k.groupBy(*keys, *TABLE_KEY).agg(
        F.sum("bytes_c2s").alias("bytes_c2s"), F.sum("bytes_s2c").alias("bytes_s2c"),
        F.sum("pkts_c2s").cast("long").alias("pkts_c2s"), F.sum("pkts_s2c").cast("long").alias("pkts_s2c"),
        F.coalesce(F.min("start_ts"), F.lit(0.0)).alias("start_ts"), F.coalesce(F.max("end_ts"), F.lit(0.0)).alias("end_ts"))
    return _finish_table(agg, keys)


def flow_table(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per oriented flow (via the shared flow facts aggregate)."""
    from .flows import flow_facts
    return table_from_facts(flow_facts(packets, keys), keys)


def _finish_table(agg: DataFrame, keys: list[str]) -> DataFrame:
    agg = agg.withColumns({"bytes_total": F.col("bytes_c2s") + F.col("bytes_s2c"),
                           "pkts_total": F.col("pkts_c2s") + F.col("pkts_s2c")})
    agg = agg.withColumn("l7_protocol_guess", guess_l7(agg))
    return agg.select(*keys, *TABLE_KEY, "l7_protocol_guess", "bytes_c2s", "bytes_s2c", "bytes_total",
                      "pkts_c2s", "pkts_s2c", "pkts_total", "start_ts", "end_ts")


def flow_sparklines(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per flow, comma-joined bytes per second from the start second to the end second for
    each direction ("" when a direction was never seen).

    Only the seconds seen are rows; each brings the run of zeros up to the next one (``lead``), so the work grows
    with the packets and not with a flow's duration. Packets without a timestamp stand in no second of a flow that
    has others; a flow without any timestamp is one second, 0."""
    flow = [*keys, *TABLE_KEY]
    k = keyed(packets, keys).withColumn("_sec", F.col("_ts").cast("long"))
    c2s = F.col("_c2s")
    per_sec = k.groupBy(*flow, "_sec").agg(
        F.sum(F.when(c2s, F.col("_len")).otherwise(0)).alias("_c"), F.sum(F.when(~c2s, F.col("_len")).otherwise(0)).alias("_s"),
        F.max(c2s).alias("_has_c"), F.max(~c2s).alias("_has_s"))
    in_order = Window.partitionBy(*flow).orderBy(F.col("_sec").asc_nulls_last())
    runs = per_sec.withColumns({"_next": F.lead("_sec").over(in_order), "_nth": F.row_number().over(in_order)})
    shown = F.col("_sec").isNotNull() | (F.col("_nth") == 1)
    zeros = F.expr("repeat(',0', cast(coalesce(_next - _sec - 1, 0) as int))")

    def line(n: str, seen: str) -> Column:
        pieces = F.array_sort(F.collect_list(F.when(shown, F.struct(F.col("_nth"), F.concat(F.col(n).cast("string"), zeros).alias("t")))))
        return F.when(F.max(seen), F.array_join(F.transform(pieces, lambda p: p["t"]), ",")).otherwise(F.lit(""))
    return runs.groupBy(*flow).agg(line("_c", "_has_c").alias("sparkline_bytes_c2s"), line("_s", "_has_s").alias("sparkline_bytes_s2c"))


# ---- G10 flow summary ------------------------------------------------------------------------
# Pick orders of the reference's summary.
DISPOSITION_PRIORITY = ["Blocked", "Degraded", "Allowed", "Unknown"]
TRAFFIC_TYPE_ORDER = ["HTTPS", "TLS", "HTTP", "DNS", "SSH", "ICMP", "TCP", "UDP", "OTHER"]
SUMMARY_COLUMNS = ["src_ip", "dest_ip", "src_port", "dest_port", "protocol", "start_time", "end_time",
                   "duration_ms", "pkts_c2s", "pkts_s2c", "pkts_total", "bytes_c2s", "bytes_s2c",
                   "bytes_total", "flow_disposition", "primary_traffic_type_guess", "security_observations",
                   "sni_hostname", "http_host", "http_path", "dns_query", "dns_response_code"]


def _rank(c: Column, order: list[str]) -> Column:
    expr = None
    for i, v in enumerate(order):
        expr = F.when(c == v, F.lit(i)) if expr is None else expr.when(c == v, F.lit(i))
    return expr.otherwise(F.lit(len(order)))


def _first_by_frame(c: Column) -> Column:
    return F.min_by(c, F.when(c.isNotNull(), F.col("frame_number")))


def flow_summary(tagged_packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per oriented flow (null direction = server→client; rows with a null key part are
    dropped) — times, counts, priority-picked disposition and traffic type, joined
    observations, first SNI/host/URI, and the DNS answer that names the server."""
    keys = list(keys)
    df = tagged_packets
    o = direction(df)
    c2s = F.coalesce(o, F.lit(False))
    src, dst = F.col("source_ip"), F.col("destination_ip")
    sp, dp = F.col("source_port"), F.col("destination_port")
    length = F.coalesce(first_present(df, ["frame_len", "packet_length"], "long"), F.lit(0))
    answers = opt(df, "dns_response_addresses", "array<string>")
    if "dns_response_addresses" in df.columns and not str(df.schema["dns_response_addresses"].dataType).startswith("Array"):
        answers = F.transform(F.split(answers, ","), lambda x: F.trim(x))
    obs = first_present(df, ["security_observations", "security_observation"])
    disp = opt(df, "flow_disposition")
    ttype = opt(df, "traffic_type_guess")
    k = df.select(
        *keys,
        F.when(c2s, src).otherwise(dst).alias("src_ip"), F.when(c2s, dst).otherwise(src).alias("dest_ip"),
        F.when(c2s, sp).otherwise(dp).alias("src_port"), F.when(c2s, dp).otherwise(sp).alias("dest_port"),
        F.col("protocol"), F.col("frame_number"), F.col("timestamp").cast("double").alias("_ts"),
        c2s.alias("_c2s"), length.alias("_len"), disp.alias("_disp"), ttype.alias("_tt"), obs.alias("_obs"),
        opt(df, "sni").alias("_sni"), opt(df, "http_request_host_header").alias("_host"),
        opt(df, "http_request_uri").alias("_uri"), opt(df, "dns_query_name").alias("_q"),
        opt(df, "dns_response_code").alias("_rc"), answers.alias("_ans"))
    k = k.where(F.col("src_ip").isNotNull() & F.col("dest_ip").isNotNull() & F.col("src_port").isNotNull()
                & F.col("dest_port").isNotNull() & F.col("protocol").isNotNull())
    dns_hit = F.coalesce(F.array_contains(F.col("_ans"), F.col("dest_ip")), F.lit(False))
    tokens = F.filter(F.transform(F.split(F.col("_obs"), ";"), lambda x: F.trim(x)), lambda x: x != "")
    g = k.groupBy(*keys, "src_ip", "dest_ip", "src_port", "dest_port", "protocol").agg(
        F.min("_ts").alias("start_time"), F.max("_ts").alias("end_time"),
        F.sum(F.when(F.col("_c2s"), 1).otherwise(0)).cast("long").alias("pkts_c2s"),
        F.sum(F.when(~F.col("_c2s"), 1).otherwise(0)).cast("long").alias("pkts_s2c"),
        F.sum(F.when(F.col("_c2s"), F.col("_len")).otherwise(0)).alias("bytes_c2s"),
        F.sum(F.when(~F.col("_c2s"), F.col("_len")).otherwise(0)).alias("bytes_s2c"),
        F.min_by(F.col("_disp"), F.when(F.col("_disp").isNotNull(),
                                        F.struct(_rank(F.col("_disp"), DISPOSITION_PRIORITY), F.col("_disp"))))
        .alias("flow_disposition"),
        F.min_by(F.col("_tt"), F.when(F.col("_tt").isNotNull(),
                                      F.struct(_rank(F.col("_tt"), TRAFFIC_TYPE_ORDER), F.col("frame_number"))))
        .alias("primary_traffic_type_guess"),
        # collect_set dedupes map-side: the buffer is bounded by distinct observation strings,
        # not by the flow's packet count.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(tokens)))).alias("_obs_set"),
        _first_by_frame(F.col("_sni")).alias("sni_hostname"),
        _first_by_frame(F.col("_host")).alias("http_host"),
        _first_by_frame(F.col("_uri")).alias("http_path"),
        _first_by_frame(F.col("_q")).alias("_q_first"),
        _first_by_frame(F.col("_rc")).alias("_rc_first"),
        F.max_by(F.struct(F.col("_q"), F.col("_rc")),
                 F.when(dns_hit, F.struct(F.col("_ts"), -F.col("frame_number")))).alias("_dns_hit"))
    hit = F.col("_dns_hit").isNotNull()
    return g.select(
        *keys, "src_ip", "dest_ip", "src_port", "dest_port", "protocol", "start_time", "end_time",
        ((F.col("end_time") - F.col("start_time")) * 1000).alias("duration_ms"),
        "pkts_c2s", "pkts_s2c", (F.col("pkts_c2s") + F.col("pkts_s2c")).alias("pkts_total"),
        "bytes_c2s", "bytes_s2c", (F.col("bytes_c2s") + F.col("bytes_s2c")).alias("bytes_total"),
        "flow_disposition", "primary_traffic_type_guess",
        F.when(F.size("_obs_set") > 0, F.array_join("_obs_set", ";")).alias("security_observations"),
        "sni_hostname", "http_host", "http_path",
        F.when(hit, F.col("_dns_hit._q")).otherwise(F.col("_q_first")).alias("dns_query"),
        F.when(hit, F.col("_dns_hit._rc")).otherwise(F.col("_rc_first")).alias("dns_response_code"))


def summary_sorted(summary: DataFrame) -> DataFrame:
    """T4: the summary in start-time order (a total sort; only at output)."""
    return summary.orderBy("start_time", "src_ip", "dest_ip", "src_port", "dest_port", "protocol")
