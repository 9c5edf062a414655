"""Direction-agnostic flow key and packet orientation (which side is the client).

Orientation is an aggregate + join, not a window: per key, the first qualifying frame and its
source endpoint (``min_by``, partially aggregated map-side, so an elephant flow is reduced
before the shuffle), then joined back to the packets (AQE splits a skewed key on the packet
side; the per-key side has one row per key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import direction, flag, has_direction, opt


def _port0(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def flow_key(df: DataFrame) -> Column:
    """G1: ``TCP_STREAM_n`` when a stream index is known; else ``PROTO_ip:port_ip:port`` over the
    sorted endpoints (missing ports read 0); else ``UNKNOWN_FLOW_<frame>``."""
    src = F.coalesce(F.col("source_ip"), F.lit(""))
    dst = F.coalesce(F.col("destination_ip"), F.lit(""))
    proto = F.coalesce(F.col("protocol"), F.lit(""))
    ends = F.sort_array(F.array(F.struct(src.alias("ip"), _port0(F.col("source_port")).alias("port")),
                                F.struct(dst.alias("ip"), _port0(F.col("destination_port")).alias("port"))))
    e0, e1 = ends[0], ends[1]
    endpoint_key = F.concat(proto, F.lit("_"), e0["ip"], F.lit(":"), e0["port"].cast("string"),
                            F.lit("_"), e1["ip"], F.lit(":"), e1["port"].cast("string"))
    stream = opt(df, "tcp_stream_index", "long")
    return (F.when(stream.isNotNull(), F.concat(F.lit("TCP_STREAM_"), stream.cast("string")))
            .when((src != "") & (dst != "") & (proto != ""), endpoint_key)
            .otherwise(F.concat(F.lit("UNKNOWN_FLOW_"), F.col("frame_number").cast("string"))))


def orient_packets(packets: DataFrame, keys: Sequence[str] = (), out: str = "is_source_client") -> DataFrame:
    """The client is the source of the first TCP SYN-without-ACK or UDP packet of the flow
    key; rows up to that frame are client-sent; keys that never qualify are all client-sent."""
    keys = list(keys)
    proto = F.upper(F.col("protocol"))
    qualifies = ((proto == "TCP") & flag(packets, "tcp_flags_syn") & ~flag(packets, "tcp_flags_ack")) | (proto == "UDP")
    df = packets.withColumn("flow_key", flow_key(packets))
    first = df.groupBy(*keys, "flow_key").agg(
        F.min(F.when(qualifies, F.col("frame_number"))).alias("_qframe"),
        F.min_by(F.struct(F.col("source_ip").alias("ip"), F.col("source_port").alias("port")),
                 F.when(qualifies, F.col("frame_number"))).alias("_client"))
    j = df.drop(out).join(first, [*keys, "flow_key"], "left")
    same = F.col("source_ip").eqNullSafe(F.col("_client.ip")) & F.col("source_port").eqNullSafe(F.col("_client.port"))
    early = F.col("_qframe").isNull() | (F.col("frame_number") <= F.col("_qframe"))
    return j.withColumn(out, F.when(early, F.lit(True)).otherwise(same)).drop("_qframe", "_client")


def ensure_direction(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Packets with ``is_source_client``: as dissected where a packet says so, else by G2."""
    if not has_direction(packets):
        return orient_packets(packets, keys)
    known = packets.withColumn("_known", direction(packets))
    out = orient_packets(known, keys, out="_guess")
    return out.withColumn("is_source_client", F.coalesce("_known", "_guess")).drop("_known", "_guess")


def orient_parser(packets: DataFrame, keys: Sequence[str] = (), out: str = "is_src_client") -> DataFrame:
    """The parser's variant — TCP only, keyed by stream index else by the *directional*
    4-tuple; null until the key's first SYN-without-ACK, then source == that SYN's source."""
    keys = list(keys)
    is_tcp = F.col("protocol") == "TCP"
    stream = opt(packets, "tcp_stream_index", "long")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
             for c in ("source_ip", "source_port", "destination_ip", "destination_port")]
    key = F.when(stream.isNotNull(), F.concat(F.lit("S"), stream.cast("string"))).otherwise(
        F.concat_ws("|", F.lit("T"), *parts))
    syn = flag(packets, "tcp_flags_syn") & ~flag(packets, "tcp_flags_ack")
    df = packets.withColumn("_okey", key)
    first = df.where(is_tcp & syn).groupBy(*keys, "_okey").agg(
        F.min_by(F.struct(F.col("frame_number").alias("f"), F.col("source_ip").alias("ip"),
                          F.col("source_port").alias("port")), F.col("frame_number")).alias("_syn"))
    j = df.drop(out).join(first, [*keys, "_okey"], "left")
    val = (F.col("source_ip").eqNullSafe(F.col("_syn.ip")) & F.col("source_port").eqNullSafe(F.col("_syn.port")))
    return j.withColumn(out, F.when(is_tcp & (F.col("frame_number") >= F.col("_syn.f")), val)).drop("_okey", "_syn")
