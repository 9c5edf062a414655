"""The metrics bundle — every report of a full analysis as a dict of lazy DataFrames.

The packets are (optionally) persisted; one per-flow "facts" aggregate feeds the flow table,
the flow signals and the TLS outcome (one packet shuffle for the three); the rule-tagged packets
and the flow table are the shared inputs of the reports. Persisting is cache, not a checkpoint:
a lost executor's blocks are recomputed from lineage, which is deterministic here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import enrich, flow_table, metrics, ordered
from ..operators.disposition import tag_flows
from ..operators.features import tagged_flows
from ..operators.flows import flow_facts
from ..operators.joins import spike_top_flows
from ..rules import default_rules, tag


def timeline_data(tl: DataFrame, spikes: DataFrame, spike_flows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per second: bytes, packets, whether it is a spike, and the spike's top flows (at most a
    handful, so the array is bounded)."""
    at = [*keys, "second"]
    top = spike_flows.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("rank", *flow_table.TABLE_KEY, "bytes_total"))).alias("top_flows"))
    marked = tl.join(spikes.select(*at, F.lit(True).alias("spike")), at, "left").fillna({"spike": False})
    return marked.join(top, at, "left")


def bundle_json(bundle: dict[str, DataFrame]) -> DataFrame:
    """The whole bundle as one table of JSON records: (report, record)."""
    parts = [df.select(F.lit(name).alias("report"), F.to_json(F.struct("*")).alias("record")) for name, df in bundle.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metrics_bundle(packets: DataFrame, rules=None, networks: DataFrame | None = None,
                   rdns: DataFrame | None = None, persist: bool = False,
                   service_guesser: Callable[[DataFrame], Column] | None = None,
                   keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    keys = list(keys)
    p = packets.persist(StorageLevel.MEMORY_AND_DISK) if persist else packets
    tagged = tag(p, rules or default_rules())
    # One packet shuffle for the flow table, the signals and the TLS outcome (shared facts).
    facts = flow_facts(p, keys)
    if persist:
        facts = facts.persist(StorageLevel.MEMORY_AND_DISK)
    ft = flow_table.table_from_facts(facts, keys)
    summary = flow_table.flow_summary(tagged, keys)
    tl = metrics.timeline(p, keys)
    spikes = metrics.spikes(tl, keys=keys)
    spike_flows = spike_top_flows(spikes, ft, flow_table.TABLE_KEY, keys=keys)
    # Errors and security findings are counted per flow: the pack runs on each flow's evidence.
    flows = tagged_flows(p, rules, keys, facts)
    out: dict[str, DataFrame] = {
        "capture_info": metrics.capture_info(p, keys),
        "protocols": metrics.protocol_counts(p, keys),
        "top_ports": metrics.top_ports(p, keys=keys),
        "tls_version_counts": metrics.tls_versions(p, keys),
        "top_talkers_by_bytes": metrics.top_by(ft, "bytes_total", flow_table.TABLE_KEY, keys=keys),
        "top_talkers_by_packets": metrics.top_by(ft, "pkts_total", flow_table.TABLE_KEY, keys=keys),
        "service_overview": metrics.service_overview(summary, rdns=rdns, guesser=service_guesser, keys=keys),
        "error_summary": metrics.error_summary(flows, keys=keys),
        "performance_metrics": metrics.performance_summary(
            ordered.handshake_rtt(p, keys), ordered.tls_time_to_alert(p, keys), ordered.retransmissions(p, keys), p, keys),
        "security_findings": metrics.security_findings(flows, keys),
        "timeline_data": timeline_data(tl, spikes, spike_flows, keys),
        "spike_top_flows": spike_flows,
        "top_flows": metrics.top_flows(summary, flow_table.TABLE_KEY, keys=keys),
        "flow_dispositions": tag_flows(p, keys, flow_id="hash", facts=facts),
    }
    if networks is not None:
        with_c = enrich.with_dest_country(ft.withColumn("flow_id", F.concat_ws("|", *flow_table.TABLE_KEY)),
                                          networks, "dest_ip")
        out["connections_to_unusual_countries"] = metrics.unusual_countries(with_c, keys=keys)
    return out
