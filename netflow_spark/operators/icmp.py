"""Correlate ICMP errors (type 3/11) with the flow of the packet they quote.

Each ICMP error carries the quoted packet's (destination ip, destination port, protocol,
ip_id). It belongs to the flow of the latest *earlier* (by frame) non-ICMP packet with that
same tuple. That is an as-of join; we prune the build side to tuples that some error quotes
(a semi-join that AQE turns into a broadcast when the error set is small at runtime) and run
the skew-safe blocked as-of lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import all_not_null, direction, opt, with_oriented_key
from ..schema import FLOW_KEY
from .asof import DEFAULT_BLOCK, asof_latest
from .flows import ICMP_ERROR_TYPES, ICMP_PROTOCOLS

_QKEY = ["_q_ip", "_q_port", "_q_proto", "_q_ipid"]


def icmp_error_matches(packets: DataFrame, keys: Sequence[str] = (), block: int = DEFAULT_BLOCK,
                       materialize: bool = False) -> DataFrame:
    """One row per ICMP error: its frame and the oriented flow key it was matched to (null if none).
    ``materialize``: checkpoint the small as-of input once (see ``asof_latest``)."""
    keys = list(keys)
    proto_u = F.upper(F.col("protocol"))
    is_icmp = proto_u.isin(ICMP_PROTOCOLS)
    icmp_type = opt(packets, "icmp_type", "long")
    orig_proto = opt(packets, "icmp_original_protocol")
    errors = packets.where(is_icmp & icmp_type.isin(ICMP_ERROR_TYPES)).select(
        *keys,
        F.col("frame_number"),
        opt(packets, "icmp_original_destination_ip").alias("_q_ip"),
        opt(packets, "icmp_original_destination_port", "long").cast("long").alias("_q_port"),
        F.when(orig_proto != "", F.upper(orig_proto)).alias("_q_proto"),
        opt(packets, "icmp_original_ip_id", "long").cast("long").alias("_q_ipid"),
    )
    cand = with_oriented_key(packets.where(~F.coalesce(is_icmp, F.lit(False)) & direction(packets).isNotNull()))
    cand = cand.where(all_not_null(FLOW_KEY)).select(
        *keys,
        F.col("frame_number"),
        F.col("destination_ip").alias("_q_ip"),
        F.col("destination_port").cast("long").alias("_q_port"),
        F.upper(F.col("protocol")).alias("_q_proto"),
        opt(packets, "ip_id", "long").cast("long").alias("_q_ipid"),
        F.struct(*[F.col(c) for c in FLOW_KEY]).alias("_flow"),
    )
    # Prune: only tuples that some error quotes (null-safe, like the reference's dict lookup).
    quoted = errors.select(*keys, *_QKEY).distinct()
    cond = F.lit(True)
    for c in [*keys, *_QKEY]:
        cond = cond & cand[c].eqNullSafe(quoted[c])
    cand = cand.join(quoted, cond, "left_semi")
    return asof_latest(errors, cand, [*keys, *_QKEY], "frame_number", "_flow", block=block, materialize=materialize)


def icmp_error_counts(packets: DataFrame, keys: Sequence[str] = (), block: int = DEFAULT_BLOCK,
                      materialize: bool = False) -> DataFrame:
    """Per oriented flow: number of downstream ICMP errors that quote one of its packets."""
    m = icmp_error_matches(packets, keys, block, materialize).where(F.col("_flow").isNotNull())
    return m.groupBy(*keys, *[F.col(f"_flow.{c}").alias(c) for c in FLOW_KEY]).agg(
        F.count(F.lit(1)).alias("icmp_error_count"))
