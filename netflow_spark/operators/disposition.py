"""Flow dispositions from flow signals, then the ordered overrides.

The cascade is a single ``when`` chain (first match wins); overrides are further ``when``s on
the same projection. ``tag_flows`` = one aggregate over oriented packets (signals + TLS
outcome), one as-of correlation for ICMP errors, a left join of the two per-flow tables, and
a projection. Nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_present, opt
from ..schema import FLOW_KEY
from .asof import DEFAULT_BLOCK
from .flows import flow_facts, signals_from_facts
from .icmp import icmp_error_counts
from .ids import dense_id, hash_id

# Fixed values: (predicate, disposition, cause) in cascade order, as shipped by the reference.
CASCADE = [
    ("allowed", "Allowed", "Completed TCP session with data exchange"),
    ("blocked_rst", "Blocked", "TCP RST from destination after SYN"),
    ("icmp_degraded", "Degraded", "ICMP Destination Unreachable/Time Exceeded in flow"),
    ("http_407", "Blocked", "Proxy Authentication Failed"),
    ("any", "Unknown", "Undetermined"),
]
TLS_FAILURE = ("Blocked", "TLS Handshake Failure")
ICMP_DOWNSTREAM = ("Degraded", "Downstream ICMP errors")
DNS_MISMATCH = ("Mis-routed", "DNS answer set doesn’t include TLS target")

TAGGED_COLUMNS = ["flow_id", *FLOW_KEY, "flow_disposition", "flow_cause", "icmp_error_count",
                  "tls_handshake_ok", "first_alert_time", "time_to_alert"]


def proxy_407(df: DataFrame) -> Column:
    """R2: HTTP with status 407 (either column spelling)."""
    proto = first_present(df, ["proto", "protocol"])
    status = first_present(df, ["http_status", "http_response_code"], "long")
    return F.coalesce((proto == "HTTP") & (status == 407), F.lit(False))


def _predicate(df: DataFrame, name: str) -> Column:
    def b(c):
        return F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
    if name == "allowed":
        return b("handshake_complete") & b("data_both")
    if name == "blocked_rst":
        return b("rst_after_syn")
    if name == "icmp_degraded":
        return b("icmp_error")
    if name == "http_407":
        return proxy_407(df)
    return F.lit(True)


def flow_disposition(flows: DataFrame) -> DataFrame:
    """First matching rule of the cascade sets ``flow_disposition`` and ``flow_cause``."""
    disp, cause = None, None
    for name, d, c in CASCADE:
        p = _predicate(flows, name)
        disp = F.when(p, F.lit(d)) if disp is None else disp.when(p, F.lit(d))
        cause = F.when(p, F.lit(c)) if cause is None else cause.when(p, F.lit(c))
    return flows.withColumns({"flow_disposition": disp.otherwise(F.lit("")),
                              "flow_cause": cause.otherwise(F.lit(""))})


def apply_overrides(tagged: DataFrame, mismatch_col: str | None = None) -> DataFrame:
    """R3, in order: DNS mismatch (only ""/Unknown) → TLS failure (always) → ICMP (only ""/Unknown)."""
    disp, cause = F.col("flow_disposition"), F.col("flow_cause")
    if mismatch_col is not None:
        m = F.coalesce(F.col(mismatch_col), F.lit(False)) & disp.isin("", "Unknown")
        tagged = tagged.withColumns({"flow_disposition": F.when(m, F.lit(DNS_MISMATCH[0])).otherwise(disp),
                                     "flow_cause": F.when(m, F.lit(DNS_MISMATCH[1])).otherwise(cause)})
    fail = F.col("tls_handshake_ok").eqNullSafe(F.lit(False))
    tagged = tagged.withColumns({"flow_disposition": F.when(fail, F.lit(TLS_FAILURE[0])).otherwise(disp),
                                 "flow_cause": F.when(fail, F.lit(TLS_FAILURE[1])).otherwise(cause)})
    icmp = (F.coalesce(opt(tagged, "icmp_error_count", "long"), F.lit(0)) > 0) & F.col("flow_disposition").isin("", "Unknown")
    return tagged.withColumns({"flow_disposition": F.when(icmp, F.lit(ICMP_DOWNSTREAM[0])).otherwise(disp),
                               "flow_cause": F.when(icmp, F.lit(ICMP_DOWNSTREAM[1])).otherwise(cause)})


def tag_flows(packets: DataFrame, keys: Sequence[str] = (), flow_id: str = "dense",
              with_app_fields: bool = False, block: int = DEFAULT_BLOCK, facts: DataFrame | None = None) -> DataFrame:
    """R4 (flagship): packets → per-flow disposition, cause and TLS/ICMP evidence.

    ``flow_id="dense"`` reproduces the reference's 0-based rank of the sorted flow key;
    ``"hash"`` is a shuffle-free 64-bit id for very large inputs.
    With ``with_app_fields`` the DNS/SNI mismatch override (J3) can fire on packet evidence.
    ``facts``: a precomputed ``flows.flow_facts`` table to share with the flow table.
    """
    keys = list(keys)
    if "frame_number" not in packets.columns:
        # Without frame numbers the reference's row order is the only order: number rows as read.
        packets = packets.withColumn("frame_number", F.monotonically_increasing_id() + 1)
    facts = facts if facts is not None else flow_facts(packets, keys)
    flows = signals_from_facts(facts, keys, ["_any_407"] if with_app_fields else [])
    if with_app_fields:
        # The HTTP status evidence, so that R2 (proxy 407) can fire on flows.
        flows = flows.withColumn("http_status", F.when(F.col("_any_407"), F.lit(407))).drop("_any_407")
    counts = icmp_error_counts(packets, keys, block)
    flows = flows.join(counts, [*keys, *FLOW_KEY], "left").fillna({"icmp_error_count": 0})
    tagged = flow_disposition(flows)
    mismatch_col = None
    if with_app_fields:
        from .dns import dns_sni_mismatch_flows
        mm = dns_sni_mismatch_flows(packets, keys).withColumn("_mismatch", F.lit(True))
        tagged = tagged.join(mm, [*keys, *FLOW_KEY], "left")
        mismatch_col = "_mismatch"
    tagged = apply_overrides(tagged, mismatch_col)
    if "http_status" in tagged.columns:
        tagged = tagged.drop("http_status")
    id_cols = [*keys, *FLOW_KEY]
    tagged = dense_id(tagged, id_cols) if flow_id == "dense" else hash_id(tagged, id_cols)
    return tagged.select(*keys, *TAGGED_COLUMNS)
