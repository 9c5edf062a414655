"""Sequence-dependent analytics re-expressed as windows and aggregates.

No operator here gives a whole flow to one task: W2–W4 first filter to the few rows that
matter (SYN/SYN-ACK, TLS handshake/alert) and then use the blocked as-of lookup (``asof``);
W1, which needs every TCP packet, uses ``with_history``: the order axis is cut into blocks so
one task never holds more than one block of one key, with the previous ``n`` rows carried into
each block. Results are exact; nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import all_not_null, flag, is_client, opt, with_oriented_key
from ..schema import FLOW_KEY
from .asof import DEFAULT_BLOCK, asof_latest

TCP_HISTORY = 64            # fixed value: packets of history per directional 4-tuple
RTT_TIMEOUT_SECONDS = 3.0   # fixed value: SYN→SYN-ACK pairs slower than this are discarded


def with_history(df: DataFrame, key: Sequence[str], order: str, value: str, last: Sequence[str], n: int,
                 block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``_hist`` = the non-null ``value``s of the ``n`` previous rows of the same key, and
    ``_last`` = struct(``last``) of the previous row (null for the key's first row). Rows are ordered
    by ``order`` (integral, unique within a key).

    All rows are shuffled once, on (key, block). The first ``n`` rows of a block prepend the
    carry-in: the last ``n`` rows of the blocks before it, taken from one row per (key, block) that
    holds the block's last ``n`` rows (``row_number <= n``, limited map-side before its shuffle).
    Only keys that span blocks have any."""
    key = list(key)
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    w = Window.partitionBy(*key, "_blk").orderBy(order)
    main = d.withColumns({"_rn": F.row_number().over(w), "_in": F.collect_list(value).over(w.rowsBetween(-n, -1)),
                          "_prev": F.lag(F.struct(*last)).over(w)})
    row = F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.struct(*last).alias("l"))
    down = Window.partitionBy(*key, "_blk").orderBy(F.col(order).desc())
    tails = (d.select(*key, "_blk", order, row.alias("_row")).withColumn("_rn", F.row_number().over(down)).where(F.col("_rn") <= n)
             .groupBy(*key, "_blk").agg(F.array_sort(F.collect_list("_row")).alias("_tail")))
    before = Window.partitionBy(*key).orderBy("_blk").rowsBetween(-n, -1)
    rows = F.flatten(F.collect_list("_tail").over(before))
    carry = tails.withColumn("_carry", rows).where(F.size("_carry") > 0).select(
        *key, "_blk", F.slice("_carry", F.greatest(F.size("_carry") - n + 1, F.lit(1)), n).alias("_carry"))
    j = main.join(carry, [*key, "_blk"], "left")
    # The rn-th row of a block has rn - 1 rows before it there; the other n - rn + 1 come from the carry.
    want = F.greatest(F.lit(n + 1) - F.col("_rn"), F.lit(0))
    earlier = F.slice("_carry", F.greatest(F.size("_carry") - want + 1, F.lit(1)), want)
    values = F.filter(F.transform(earlier, lambda x: x["v"]), lambda x: x.isNotNull())
    return j.withColumns({
        "_hist": F.when(F.col("_carry").isNotNull() & (want > 0), F.concat(values, F.col("_in"))).otherwise(F.col("_in")),
        "_last": F.when(F.col("_rn") == 1, F.try_element_at(F.col("_carry"), F.lit(-1))["l"]).otherwise(F.col("_prev")),
    }).drop("_blk", "_rn", "_in", "_prev", "_carry")


def _key4(df: DataFrame) -> dict[str, Column]:
    def port(c):
        v = opt(df, c, "long").try_cast("double").try_cast("long")
        return F.when(F.coalesce(v, F.lit(0)) == 0, F.lit(-1).cast("long")).otherwise(v)
    return {"_k_src": F.coalesce(opt(df, "source_ip"), F.lit("")), "_k_sport": port("source_port"),
            "_k_dst": F.coalesce(opt(df, "destination_ip"), F.lit("")), "_k_dport": port("destination_port")}


def tcp_heuristics(packets: DataFrame, keys: Sequence[str] = (), history: int = TCP_HISTORY,
                   block: int = DEFAULT_BLOCK, carry: Sequence[str] = (), any_case: bool = False) -> DataFrame:
    """Per TCP packet, heuristic retransmission / duplicate ACK / out-of-order / zero-window
    flags from the previous ``history`` packets of the same directional 4-tuple. ``carry``
    columns are passed through (so callers can aggregate without joining back by frame).
    ``any_case``: also packets whose protocol is written ``tcp``."""
    keys = list(keys)
    carry = list(carry)
    tcp = packets.where((F.upper("protocol") if any_case else F.col("protocol")) == "TCP")
    base = tcp.select(*keys, "frame_number", *carry, *[v.alias(k) for k, v in _key4(tcp).items()],
                      opt(tcp, "tcp_sequence_number", "long").cast("long").alias("seq"),
                      opt(tcp, "tcp_acknowledgment_number", "long").cast("long").alias("ack"),
                      opt(tcp, "tcp_window_size", "long").cast("long").alias("win"),
                      F.coalesce(opt(tcp, "tcp_payload_length", "long").cast("long"), F.lit(0).cast("long")).alias("len"))
    key = [*keys, "_k_src", "_k_sport", "_k_dst", "_k_dport"]
    h = with_history(base, key, "frame_number", "seq", ["seq", "ack", "win", "len"], history, block)
    has, last = F.col("_last").isNotNull(), F.col("_last")
    seen = F.coalesce(F.array_contains("_hist", F.col("seq")), F.lit(False))
    retrans = F.col("seq").isNotNull() & seen
    dup = has & F.coalesce((F.col("ack") == last["ack"]) & (F.col("len") == 0), F.lit(False))
    expected = F.coalesce(last["seq"], F.lit(0)) + F.coalesce(last["len"], F.lit(0))
    ooo = has & F.coalesce((F.col("seq") < expected) & ~seen, F.lit(False))
    zero = has & F.coalesce((F.col("win") == 0) & (last["win"] != 0), F.lit(False))
    return h.select(*keys, "frame_number", *carry, retrans.alias("heuristic_retransmission"),
                    dup.alias("heuristic_duplicate_ack"), ooo.alias("heuristic_out_of_order"),
                    zero.alias("heuristic_zero_window"))


def retransmissions(packets: DataFrame, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Per TCP packet: ``heuristic_retransmission`` = whether the dissector's retransmission flags
    name any, where the packet carries such flags (a non-null list), else the W1 heuristic."""
    keys, carry = list(keys), list(carry)
    flags = opt(packets, "tcp_analysis_retransmission_flags", "array<string>")
    seen = packets.withColumn("_dissected", F.when(flags.isNotNull(), F.size(flags) > 0))
    heur = tcp_heuristics(seen, keys, carry=[*carry, "_dissected"], any_case=True)
    return heur.select(*keys, "frame_number", *carry,
                       F.coalesce("_dissected", "heuristic_retransmission").alias("heuristic_retransmission"))


def with_heuristic_flags(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Packets with the four ``tcp_analysis_*_flags`` token arrays filled from W1 (TCP rows)."""
    keys = list(keys)
    hf = tcp_heuristics(packets, keys)
    j = packets.join(hf, [*keys, "frame_number"], "left")

    def tok(c, name):
        return F.array_compact(F.array(F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(name))))
    return j.withColumns({
        "tcp_analysis_retransmission_flags": tok("heuristic_retransmission", "heuristic_retransmission"),
        "tcp_analysis_duplicate_ack_flags": tok("heuristic_duplicate_ack", "heuristic_duplicate_ack"),
        "tcp_analysis_out_of_order_flags": tok("heuristic_out_of_order", "heuristic_out_of_order"),
        "tcp_analysis_window_flags": tok("heuristic_zero_window", "heuristic_zero_window"),
    }).drop("heuristic_retransmission", "heuristic_duplicate_ack", "heuristic_out_of_order",
            "heuristic_zero_window")


def packet_rtt(packets: DataFrame, keys: Sequence[str] = (), block: int = DEFAULT_BLOCK) -> DataFrame:
    """On each SYN-ACK, ms since the latest unmatched SYN of the reverse 4-tuple — i.e. when
    the previous handshake packet of that 4-tuple (by frame) is a SYN. Blocked as-of lookup."""
    keys = list(keys)
    syn, ack = flag(packets, "tcp_flags_syn"), flag(packets, "tcp_flags_ack")
    tcp = packets.where((F.col("protocol") == "TCP") & syn)
    s_ok = all_not_null(["source_ip", "destination_ip", "source_port", "destination_port"])
    is_syn = ~ack
    rows = tcp.where(s_ok).select(
        *keys, "frame_number", F.col("timestamp").cast("double").alias("ts"), is_syn.alias("_is_syn"),
        F.when(is_syn, F.col("source_ip")).otherwise(F.col("destination_ip")).alias("_a_ip"),
        F.when(is_syn, F.col("source_port")).otherwise(F.col("destination_port")).alias("_a_port"),
        F.when(is_syn, F.col("destination_ip")).otherwise(F.col("source_ip")).alias("_b_ip"),
        F.when(is_syn, F.col("destination_port")).otherwise(F.col("source_port")).alias("_b_port"))
    key = [*keys, "_a_ip", "_a_port", "_b_ip", "_b_port"]
    build = rows.select(*key, "frame_number", F.struct(F.col("_is_syn").alias("s"), F.col("ts").alias("t")).alias("_prev"))
    probe = rows.where(~F.col("_is_syn")).select(*key, "frame_number", "ts")
    r = asof_latest(probe, build, key, "frame_number", "_prev", block=block)
    return r.where(F.coalesce(F.col("_prev.s"), F.lit(False))).select(
        *keys, "frame_number", ((F.col("ts") - F.col("_prev.t")) * 1000.0).alias("tcp_rtt_ms"))


def handshake_rtt(packets: DataFrame, keys: Sequence[str] = (), block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per oriented flow, a server SYN-ACK is matched to the latest client SYN before it when
    ack = SYN seq + 1; each SYN is matched at most once (by its first matching SYN-ACK). One row
    per sample (ms). Blocked as-of lookup + a partial aggregate — no per-flow window."""
    keys = list(keys)
    syn, ack = flag(packets, "tcp_flags_syn"), flag(packets, "tcp_flags_ack")
    c = is_client(packets)
    tcp = packets.where(F.upper(F.col("protocol")) == "TCP")
    o = with_oriented_key(tcp.where((c & syn & ~ack) | (~F.coalesce(c, F.lit(False)) & syn & ack)))
    o = o.select(*keys, *FLOW_KEY, "frame_number", F.col("timestamp").cast("double").alias("ts"),
                 (is_client(tcp) & syn & ~ack).alias("_is_syn"),
                 F.coalesce(opt(tcp, "tcp_sequence_number", "long").cast("long"), F.lit(0).cast("long")).alias("_seq"),
                 F.coalesce(opt(tcp, "tcp_acknowledgment_number", "long").cast("long"), F.lit(-1).cast("long")).alias("_ack"))
    part = [*keys, *FLOW_KEY]
    syns = o.where("_is_syn").select(*part, "frame_number", F.struct(
        F.col("frame_number").alias("f"), F.col("ts").alias("t"), F.col("_seq").alias("seq")).alias("_syn"))
    acks = o.where(~F.col("_is_syn")).select(*part, "frame_number", "ts", "_ack")
    m = asof_latest(acks, syns, part, "frame_number", "_syn", block=block)
    cand = m.where(F.col("_syn").isNotNull() & (F.col("_ack") == F.col("_syn.seq") + 1))
    first = cand.groupBy(*part, F.col("_syn.f").alias("_sf")).agg(
        F.min_by(F.struct("frame_number", "ts"), F.col("frame_number")).alias("_a"),
        F.first("_syn.t").alias("_st"))
    return first.select(*part, F.col("_a.frame_number").alias("frame_number"),
                        ((F.col("_a.ts") - F.col("_st")) * 1000).alias("rtt_ms"))


def tls_time_to_alert(packets: DataFrame, keys: Sequence[str] = (), block: int = DEFAULT_BLOCK) -> DataFrame:
    """Per oriented flow, ms from the first TLS handshake packet after the previous alert to
    the next alert (kept when ≥ 0). One row per alert with a handshake before it.

    Every handshake or alert row looks up the latest alert strictly before it (blocked as-of);
    handshakes grouped by that alert give each segment's start, which joins to the alert whose
    own previous alert is the same."""
    keys = list(keys)
    hs = F.coalesce(opt(packets, "tls_handshake_type") != "", F.lit(False))
    al = F.coalesce(opt(packets, "tls_alert_message_description") != "", F.lit(False))
    o = with_oriented_key(packets.where(hs | al)).select(
        *keys, *FLOW_KEY, "frame_number", F.col("timestamp").cast("double").alias("ts"),
        hs.alias("_hs"), al.alias("_al"))
    part = [*keys, *FLOW_KEY]
    alerts = o.where("_al").select(*part, "frame_number", F.col("frame_number").alias("_prev_alert"))
    seg = asof_latest(o, alerts, part, "frame_number", "_prev_alert", block=block)
    seg = seg.withColumn("_seg", F.coalesce(F.col("_prev_alert"), F.lit(-1).cast("long")))
    starts = seg.where("_hs").groupBy(*part, "_seg").agg(F.min_by("ts", F.col("frame_number")).alias("_start"))
    ends = seg.where("_al").select(*part, "_seg", "frame_number", F.col("ts").alias("_alert"))
    cond = F.lit(True)
    for c in [*part, "_seg"]:
        cond = cond & ends[c].eqNullSafe(starts[c])  # a flow key may hold nulls (null-safe, as grouping)
    j = ends.join(starts, cond, "inner")
    d = (F.col("_alert") - F.col("_start")) * 1000.0
    return j.where(d >= 0).select(*[ends[c] for c in part], ends["frame_number"], d.alias("time_to_alert_ms"))


def rtt_samples(packets: DataFrame, keys: Sequence[str] = (), timeout: float = RTT_TIMEOUT_SECONDS) -> DataFrame:
    """First SYN ⋈ first SYN-ACK on the reversed 4-tuple (missing ip → "", port → 0); keep
    SYN-ACK ≥ SYN and RTT ≤ timeout. Two aggregates and one equi-join on the 4-tuple."""
    keys = list(keys)
    tcp = packets.where(F.upper(F.col("protocol")) == "TCP")
    syn, ack = flag(tcp, "tcp_flags_syn"), flag(tcp, "tcp_flags_ack")

    def ip(c):
        return F.coalesce(F.col(c), F.lit(""))

    def port(c):
        return F.coalesce(F.col(c).try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    k = ["c_ip", "c_port", "s_ip", "s_port"]
    s = tcp.where(syn & ~ack).groupBy(
        *keys, ip("source_ip").alias("c_ip"), port("source_port").alias("c_port"),
        ip("destination_ip").alias("s_ip"), port("destination_port").alias("s_port")).agg(
        F.min("timestamp").alias("syn_time"))
    a = tcp.where(syn & ack).groupBy(
        *keys, ip("destination_ip").alias("c_ip"), port("destination_port").alias("c_port"),
        ip("source_ip").alias("s_ip"), port("source_port").alias("s_port")).agg(
        F.min("timestamp").alias("synack_time"))
    j = s.join(a, [*keys, *k], "inner")
    rtt = (F.col("synack_time") - F.col("syn_time")) * 1000.0
    return j.where((F.col("synack_time") >= F.col("syn_time")) & (rtt <= timeout * 1000.0)).select(
        *keys, *k, "syn_time", "synack_time", rtt.alias("rtt_ms"))
