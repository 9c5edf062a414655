"""Aggregations over packets and tagged flows.

Global statistics are one-row aggregates joined (broadcast: a single row is a proven size) to
the rows they qualify — never ``Window.partitionBy()`` with no key. Per-group top-k uses
``row_number() <= k``, which Spark plans as a partial group limit before the shuffle
(WindowGroupLimit), so a hot group ships at most k rows per map partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import (guess_service, is_plaintext_http, packet_error_reason, service_open,
                                   split_port_key)
from ..functions.columns import first_present, flag, opt
from .quantiles import exact_quantiles

# Fixed values (limits and weights that must equal the reference's for equal results).
SPIKE_SIGMA = 3.0
TOP_PORTS = 10
TOP_TALKERS = 20
COMMON_COUNTRIES = ["US", "CA", "GB", "DE", "FR", "NL", "JP", "AU"]
SCORE_BLOCKED = 1000
SCORE_DEGRADED = 500
SCORE_PER_OBSERVATION = 200
BYTES_SCORE_DIVISOR = 1_000_000
ERROR_SAMPLE_IDS = 3


def protocol_counts(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A1: packets per lower-cased protocol (empty/null protocol not counted)."""
    p = F.col("protocol")
    return (packets.where(p.isNotNull() & (p != ""))
            .groupBy(*keys, F.lower(p).alias("protocol")).agg(F.count(F.lit(1)).alias("packets")))


def port_counts(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A2 input: packets per ``tcp_<port>`` / ``udp_<port>`` (missing port → 0)."""
    proto = F.lower(F.col("protocol"))
    port = F.coalesce(F.col("destination_port").try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    return (packets.where(proto.isin("tcp", "udp"))
            .groupBy(*keys, F.concat(proto, F.lit("_"), port.cast("string")).alias("port_key"))
            .agg(F.count(F.lit(1)).alias("packets")))


def _top(df: DataFrame, order: Sequence[Column], n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order``, per ``keys`` group if there are keys."""
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def top_ports(packets: DataFrame, n: int = TOP_PORTS, keys: Sequence[str] = ()) -> DataFrame:
    """A2 (+P16): the ``n`` busiest ports; ties by key ascending."""
    top = _top(port_counts(packets, keys), [F.col("packets").desc(), F.col("port_key").asc()], n, keys)
    sp = split_port_key(F.col("port_key"))
    return top.select(*keys, "port_key", sp["protocol"].alias("protocol"), sp["port"].alias("port"), "packets")


def tls_versions(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A3: packets per non-empty TLS version."""
    v = opt(packets, "tls_effective_version")
    return (packets.where(v.isNotNull() & (v != ""))
            .groupBy(*keys, v.alias("tls_version")).agg(F.count(F.lit(1)).alias("packets")))


def timeline(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A4: bytes and packets per whole second (observed seconds only)."""
    sec = F.coalesce(F.col("timestamp").cast("double"), F.lit(0.0)).cast("long")
    return packets.groupBy(*keys, sec.alias("second")).agg(
        F.sum(F.coalesce(F.col("packet_length").cast("long"), F.lit(0))).alias("bytes"),
        F.count(F.lit(1)).alias("packets"))


def spikes(tl: DataFrame, value: str = "bytes", sigma: float = SPIKE_SIGMA, keys: Sequence[str] = ()) -> DataFrame:
    """A5: bins whose value exceeds mean + sigma·(population σ); none when ≤ 1 distinct value."""
    keys = list(keys)
    stats = tl.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"),
                                  F.count_distinct(value).alias("_nd"))
    # without keys one row; with keys a row per group, which grows with the data
    j = tl.join(stats, keys, "inner") if keys else tl.crossJoin(F.broadcast(stats))
    thr = F.col("_mean") + F.lit(sigma) * F.col("_std")
    return j.where((F.col("_nd") > 1) & (F.col("_std") > 0) & (F.col(value) > thr)).drop("_mean", "_std", "_nd")


def _beside(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``other`` (at most one row per ``keys`` group) beside ``base`` (one row per group). Without
    keys both are one row: a proven size."""
    if keys:
        return base.join(other, list(keys), "left")
    return base.withColumn("_k", F.lit(1)).join(F.broadcast(other.withColumn("_k", F.lit(1))), "_k", "left").drop("_k")


def rtt_stats(samples: DataFrame, col: str = "rtt_ms", keys: Sequence[str] = ()) -> DataFrame:
    """Median, p95 (linear interpolation, exact and distributed), min, max, sample count;
    ``reason`` when empty. With ``keys``, one row per group that has samples."""
    a = samples.groupBy(*keys).agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count(col).alias("samples"))
    q = exact_quantiles(samples, col, [0.5, 0.95], keys).select(*keys, F.col("q0").alias("median"), F.col("q1").alias("p95"))
    return _beside(a, q, keys).select(
        *keys, "median", "p95", "min", "max", "samples",
        F.when(F.col("samples") == 0, F.lit("insufficient_syn_ack_pairs")).alias("reason"))


def performance_summary(rtts: DataFrame, alerts: DataFrame, heur: DataFrame, packets: DataFrame,
                        keys: Sequence[str] = ()) -> DataFrame:
    """Per ``keys`` group (or one row) — RTT stats, SYN RTT median, TLS time-to-alert median,
    retransmission % of TCP packets, limited-data flag."""
    tcp = F.upper(F.col("protocol")) == "TCP"
    base = packets.groupBy(*keys).agg(F.count_if(tcp).alias("_n"))
    r = rtt_stats(rtts, keys=keys).select(
        *keys, F.col("median").alias("rtt_median_ms"), F.col("p95").alias("rtt_p95_ms"), F.col("min").alias("rtt_min_ms"),
        F.col("max").alias("rtt_max_ms"), F.col("samples").alias("_samples"))
    a = exact_quantiles(alerts, "time_to_alert_ms", [0.5], keys).select(*keys, F.col("q0").alias("tls_time_to_alert_ms"))
    rt = heur.groupBy(*keys).agg(F.sum(F.col("heuristic_retransmission").cast("int")).alias("_r"))
    j = _beside(_beside(_beside(base, r, keys), a, keys), rt, keys)
    samples = F.coalesce("_samples", F.lit(0).cast("long"))
    pct = F.when(F.col("_n") > 0, F.coalesce(F.col("_r"), F.lit(0)) * 100.0 / F.col("_n")).otherwise(F.lit(0.0))
    return j.select(*keys, "rtt_median_ms", "rtt_p95_ms", "rtt_min_ms", "rtt_max_ms", samples.alias("rtt_samples"),
                    F.col("rtt_median_ms").alias("tcp_syn_rtt_ms"), (samples == 0).alias("rtt_limited_data"),
                    "tls_time_to_alert_ms", pct.alias("tcp_retransmission_ratio_percent"))


def with_service(flows: DataFrame, rdns: DataFrame | None = None, guesser=None, out: str = "service") -> DataFrame:
    """P10 as a column: only rows that SNI, host, QUIC and port leave undecided meet ``rdns`` (an
    (ip, rdns) dimension), so a busy server with a known service is no hot join key."""
    if guesser is not None:
        return flows.withColumn(out, guesser(flows))
    port = first_present(flows, ["destination_port", "dest_port", "server_port"], "long")
    parts = {"sni": first_present(flows, ["sni", "sni_hostname", "server_name_indication"]),
             "http_host": first_present(flows, ["http_request_host_header", "http_host"]),
             "is_quic": opt(flows, "is_quic", "boolean")}
    if rdns is None:
        return flows.withColumn(out, guess_service(F.col("protocol"), port, **parts))
    f = flows.withColumn("_svc", guess_service(F.col("protocol"), port, **parts))
    f = f.withColumn("_open", service_open(F.col("protocol"), port, **parts))
    f = f.withColumn("_dst", F.when(F.col("_open"), first_present(flows, ["destination_ip", "dest_ip", "server_ip"])))
    names = rdns.select(F.col("ip").alias("_dst"), F.nullif(F.split("rdns", r"\.")[0], F.lit("")).alias("_label"))
    asked = f.where(F.col("_dst").isNotNull()).join(names, "_dst", "left").withColumn(out, F.coalesce("_label", "_svc"))
    rest = f.where(F.col("_dst").isNull()).withColumn(out, F.col("_svc"))
    keep = [*[c for c in flows.columns if c != out], out]
    return rest.select(*keep).unionByName(asked.select(*keep))


def service_overview(flows: DataFrame, rdns: DataFrame | None = None, guesser=None, keys: Sequence[str] = ()) -> DataFrame:
    """Flows and bytes per service label (P10). ``rdns``: optional (ip, rdns) dimension.
    U3: ``guesser(df) -> Column`` replaces the built-in service guess."""
    f = with_service(flows, rdns, guesser, "_service")
    return f.groupBy(*keys, F.col("_service").alias("service")).agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.sum(F.coalesce(opt(f, "bytes_total", "long").cast("long"), F.lit(0))).alias("bytes"))


def error_summary(tagged: DataFrame, id_col: str = "flow_id", k: int = ERROR_SAMPLE_IDS, keys: Sequence[str] = ()) -> DataFrame:
    """Per (type, detail) — or per type when there is no detail column — the number of tagged
    flows and up to ``k`` distinct sample ids (ascending). One aggregate to (type, detail, id) feeds both."""
    keys = list(keys)
    if "flow_error_type" not in tagged.columns:
        return tagged.sparkSession.createDataFrame(
            [], ", ".join([*[f"{c} {tagged.schema[c].dataType.simpleString()}" for c in keys],
                           "error_type string, error_detail string, count long, sample_flow_ids array<string>"]))
    has_detail = "flow_error_details" in tagged.columns
    d = tagged.where(F.col("flow_error_type").isNotNull())
    detail = F.col("flow_error_details") if has_detail else F.lit(None).cast("string")
    if has_detail:
        d = d.where(F.col("flow_error_details").isNotNull())
    g = [*keys, "error_type", "error_detail"]
    per_id = d.groupBy(*keys, F.col("flow_error_type").cast("string").alias("error_type"), detail.alias("error_detail"),
                       opt(d, id_col).cast("string").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    counts = per_id.groupBy(*g).agg(F.sum("_n").alias("count"))
    w = Window.partitionBy(*g).orderBy("_id")
    sample = (per_id.where(F.col("_id").isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
              .groupBy(*g).agg(F.array_sort(F.collect_list("_id")).alias("sample_flow_ids")))
    cond = F.lit(True)
    for c in g:
        cond = cond & counts[c].eqNullSafe(sample[c])
    return counts.join(sample, cond, "left").select(
        *[counts[c] for c in g], counts["count"],
        F.coalesce(sample["sample_flow_ids"], F.array().cast("array<string>")).alias("sample_flow_ids"))


def error_rows(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(Type, Description, Count) rows; Description is "" when there are no details."""
    return summary.select(*keys, F.col("error_type").alias("Type"),
                          F.coalesce(F.col("error_detail"), F.lit("")).alias("Description"),
                          F.col("count").alias("Count"))


def error_total(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A10: total error count."""
    return summary.groupBy(*keys).agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_errors"))


def security_findings(tagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(finding, detail, flows) rows over tagged flows — plaintext HTTP, self-signed
    certificates, outdated TLS versions per version."""
    plain = flag(tagged, "security_flag_plaintext_http")
    selfs = flag(tagged, "security_flag_self_signed_cert")
    outdated = opt(tagged, "security_flag_outdated_tls_version")
    counts = tagged.groupBy(*keys).agg(F.count_if(plain).alias("p"), F.count_if(selfs).alias("s"))
    fixed = counts.select(*keys, F.explode(F.array(
        F.struct(F.lit("plaintext_http_flows").alias("finding"), F.lit("").alias("detail"), F.col("p").alias("flows")),
        F.struct(F.lit("self_signed_certificate_flows").alias("finding"), F.lit("").alias("detail"), F.col("s").alias("flows")),
    )).alias("r")).select(*keys, "r.*")
    versions = (tagged.where(outdated.isNotNull())
                .groupBy(*keys, F.lit("outdated_tls_version_counts").alias("finding"), outdated.cast("string").alias("detail"))
                .agg(F.count(F.lit(1)).alias("flows")))
    return fixed.unionByName(versions)


def unusual_countries(flows_with_country: DataFrame, id_col: str = "flow_id", country_col: str = "dest_country",
                      common: Sequence[str] = COMMON_COUNTRIES, keys: Sequence[str] = ()) -> DataFrame:
    """Flows whose destination country is known and not a common one."""
    c = F.col(country_col)
    return (flows_with_country.where(c.isNotNull() & ~c.isin(list(common)))
            .select(*keys, F.col(id_col).cast("string").alias("flow_id"), c.alias("country")))


def security_total(findings: DataFrame, unusual: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total security issues = all finding counts + unusual-country flows."""
    a = findings.groupBy(*keys).agg(F.coalesce(F.sum("flows"), F.lit(0)).alias("_a"))
    b = unusual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_b"))
    return _beside(a, b, keys).select(*keys, (F.col("_a") + F.coalesce("_b", F.lit(0))).cast("long").alias("security_issues"))


def plaintext_flows(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of distinct directional 5-tuples carrying plaintext HTTP."""
    proto = F.upper(F.coalesce(F.col("protocol"), F.lit("")))
    d = packets.where(is_plaintext_http(packets)).select(
        *keys, "source_ip", "destination_ip", "source_port", "destination_port", proto.alias("p")).distinct()
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("plaintext_flows"))


def outcome_by_protocol(tagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Flows per (protocol, flow_outcome)."""
    return tagged.groupBy(*keys, "protocol", "flow_outcome").agg(F.count(F.lit(1)).alias("flows"))


def errors_by_reason(rows: DataFrame, id_col: str = "flow_id", bytes_col: str = "total_bytes",
                     ts_col: str = "first_ts", keys: Sequence[str] = ()) -> DataFrame:
    """Per packet error reason — distinct flows, bytes, first seen."""
    r = F.col("packet_error_reason")
    return rows.where(r.isNotNull()).groupBy(*keys, r.alias("packet_error_reason")).agg(
        F.count_distinct(id_col).alias("affected_flows"), F.sum(bytes_col).alias("total_bytes"),
        F.min(ts_col).alias("first_seen"))


def capture_info(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per capture — packets, first/last time, duration, QUIC vs TLS packet counts."""
    tls = opt(packets, "tls_effective_version").isNotNull() | opt(packets, "tls_handshake_type").isNotNull()
    a = packets.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_packets"), F.min("timestamp").alias("first_timestamp"),
                    F.max("timestamp").alias("last_timestamp"), F.count_if(flag(packets, "is_quic")).alias("quic_packets"),
                    F.count_if(tls).alias("tls_packets"))
    return a.withColumn("capture_duration", F.col("last_timestamp") - F.col("first_timestamp"))


def diagnostic_score(flows: DataFrame) -> Column:
    """Blocked* +1000 / *Degraded* +500, +200 per security observation ("none" ignored,
    ``;``/``,`` separated, or array length), + bytes/1e6 (missing bytes → 0)."""
    d = F.coalesce(opt(flows, "flow_disposition").cast("string"), F.lit(""))
    disp = F.when(d.startswith("Blocked"), F.lit(SCORE_BLOCKED)).when(d.contains("Degraded"), F.lit(SCORE_DEGRADED)).otherwise(0)
    obs_name = "security_observations" if "security_observations" in flows.columns else "security_observation"
    if obs_name in flows.columns and str(flows.schema[obs_name].dataType).startswith("Array"):
        n_obs = F.coalesce(F.size(F.col(obs_name)), F.lit(0))
        n_obs = F.when(n_obs < 0, 0).otherwise(n_obs)
    else:
        o = F.trim(opt(flows, obs_name).cast("string"))
        parts = F.filter(F.split(o, "[;,]+"), lambda x: F.trim(x) != "")
        n_obs = F.when(o.isNotNull() & (o != "") & (F.lower(o) != "none"), F.size(parts)).otherwise(0)
    b = F.coalesce(opt(flows, "bytes_total", "double").cast("double"), F.lit(0.0)) / F.lit(float(BYTES_SCORE_DIVISOR))
    return (F.lit(0.0) + disp.cast("double") + (F.lit(SCORE_PER_OBSERVATION) * n_obs).cast("double")) + b


def top_flows(flows: DataFrame, tie_cols: Sequence[str], n: int = TOP_TALKERS, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` most diagnostically relevant flows (score desc, ties by key), per ``keys`` group."""
    return _top(flows.withColumn("score", diagnostic_score(flows)),
                [F.col("score").desc(), *[F.col(c).asc() for c in tie_cols]], n, keys)


def top_by(flows: DataFrame, col: str, tie_cols: Sequence[str], n: int = TOP_TALKERS, keys: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` by ``col``, per ``keys`` group (a per-partition top-n, then a merge)."""
    return _top(flows, [F.col(col).desc(), *[F.col(c).asc() for c in tie_cols]], n, keys)


def errors_input(packets: DataFrame) -> DataFrame:
    return packets.withColumn("packet_error_reason", packet_error_reason(packets))
