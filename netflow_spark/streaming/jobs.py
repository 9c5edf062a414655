"""ST1–ST4: the streaming forms of the timeline, flow table, handshake RTT and DNS/SNI check.

Each function takes a *streaming* packets DataFrame (``spark.readStream...``) and returns a
streaming DataFrame; the caller picks the sink. Event time is ``timestamp`` (float seconds)
turned into a ``TimestampType`` column for watermarks. The watermark is a parameter: rows
later than it are dropped by Spark (the batch operators never drop rows), and append-mode
results appear only once the watermark passes the end of their window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import all_not_null, direction, flag, is_client, opt, with_oriented_key
from ..functions.classify import dns_answers
from ..schema import FLOW_KEY
from ..operators.dns import DNS_TLS_MAX_AGE_SECONDS

DEFAULT_WATERMARK = "1 hour"


def with_event_time(df: DataFrame, col: str = "timestamp") -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds(F.col(col)))


def streaming_timeline(packets: DataFrame, watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST1: bytes and packets per 1-second tumbling window (append mode)."""
    d = with_event_time(packets).withWatermark("event_time", watermark)
    g = d.groupBy(F.window("event_time", "1 second")).agg(
        F.sum(F.coalesce(F.col("packet_length").cast("long"), F.lit(0))).alias("bytes"),
        F.count(F.lit(1)).alias("packets"))
    return g.select(F.unix_seconds(F.col("window.start")).alias("second"), "bytes", "packets")


def streaming_flow_table(packets: DataFrame, gap: str = "5 minutes", watermark: str = DEFAULT_WATERMARK) -> DataFrame:
    """ST2: per oriented flow and activity session (``session_window`` with ``gap``): bytes and
    packets per direction, start and end (append mode: a session is emitted once closed)."""
    o = F.coalesce(direction(packets), F.lit(False))
    d = with_event_time(packets).withWatermark("event_time", watermark)
    d = d.select(
        "event_time", F.col("timestamp").cast("double").alias("ts"),
        F.when(o, F.coalesce("source_ip", F.lit(""))).otherwise(F.coalesce("destination_ip", F.lit(""))).alias("src_ip"),
        F.when(o, F.coalesce("destination_ip", F.lit(""))).otherwise(F.coalesce("source_ip", F.lit(""))).alias("dest_ip"),
        F.when(o, F.coalesce("source_port", F.lit(0))).otherwise(F.coalesce("destination_port", F.lit(0))).cast("long").alias("src_port"),
        F.when(o, F.coalesce("destination_port", F.lit(0))).otherwise(F.coalesce("source_port", F.lit(0))).cast("long").alias("dest_port"),
        F.coalesce("protocol", F.lit("")).alias("protocol"), o.alias("c2s"),
        F.coalesce(F.col("packet_length").cast("long"), F.lit(0)).alias("len"))
    g = d.groupBy(F.session_window("event_time", gap), "src_ip", "dest_ip", "src_port", "dest_port", "protocol").agg(
        F.sum(F.when(F.col("c2s"), F.col("len")).otherwise(0)).alias("bytes_c2s"),
        F.sum(F.when(~F.col("c2s"), F.col("len")).otherwise(0)).alias("bytes_s2c"),
        F.sum(F.when(F.col("c2s"), 1).otherwise(0)).cast("long").alias("pkts_c2s"),
        F.sum(F.when(~F.col("c2s"), 1).otherwise(0)).cast("long").alias("pkts_s2c"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return g.select("src_ip", "dest_ip", "src_port", "dest_port", "protocol", "bytes_c2s", "bytes_s2c",
                    (F.col("bytes_c2s") + F.col("bytes_s2c")).alias("bytes_total"), "pkts_c2s", "pkts_s2c",
                    (F.col("pkts_c2s") + F.col("pkts_s2c")).alias("pkts_total"), "start_ts", "end_ts")


_RTT_OUT = T.StructType([*(T.StructField(c, t) for c, t in [
    ("client_ip", T.StringType()), ("server_ip", T.StringType()), ("client_port", T.LongType()),
    ("server_port", T.LongType()), ("protocol", T.StringType()), ("frame_number", T.LongType()),
    ("rtt_ms", T.DoubleType())])])
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The stateful jobs keep lists and timers, which Spark offers on the RocksDB state store only."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != _ROCKSDB:
        spark.conf.set(key, _ROCKSDB)


def _due_ms(seconds: float) -> int:
    return math.ceil(seconds * 1000)


class HandshakeRtt(StatefulProcessor):
    """Per oriented flow: rows wait in list state, each with an event-time timer of its own, until the watermark
    passes them and are then taken in frame order, whichever micro-batch brought them. The latest client SYN is kept;
    a server SYN-ACK that acknowledges SYN seq + 1 yields one sample and clears it. A SYN without an answer goes
    ``max_wait`` seconds after its own event time."""

    def __init__(self, max_wait: float):
        self.max_wait = max_wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts double, frame long, is_syn boolean, seq long, ack long")
        self.syn = handle.getValueState("syn", "ts double, seq long")
        self.done = None

    def handleInputRows(self, key, rows, timerValues):
        new = [(float(r.ts), int(r.frame_number), bool(r.is_syn), int(r.seq), int(r.ack)) for r in rows]
        self.waiting.appendList(new)
        for ms in {_due_ms(r[0]) for r in new}:
            self.handle.registerTimer(ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        if self.done == (key, mark):  # the first of a flow's timers has taken all rows that are due
            return
        self.done = (key, mark)
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in rows if _due_ms(r[0]) < mark), key=lambda r: r[1])
        syn_ts, syn_seq = self.syn.get() if self.syn.exists() else (None, None)
        for ts, frame, is_syn, seq, ack in due:
            if is_syn:
                syn_ts, syn_seq = ts, seq
            elif syn_ts is not None and ack == syn_seq + 1:
                yield Row(*_RTT_OUT.names)(*key, frame, (ts - syn_ts) * 1000.0)
                syn_ts, syn_seq = None, None
        if due:
            left = [r for r in rows if _due_ms(r[0]) >= mark]
            self.waiting.put(left) if left else self.waiting.clear()
        if syn_ts is not None and _due_ms(syn_ts + self.max_wait) >= mark:
            self.syn.update((syn_ts, syn_seq))
            self.handle.registerTimer(_due_ms(syn_ts + self.max_wait))
        else:
            self.syn.clear()

    def close(self) -> None:
        pass


def streaming_handshake_rtt(packets: DataFrame, watermark: str = DEFAULT_WATERMARK, max_wait: float = 3600.0) -> DataFrame:
    """ST3: handshake RTT samples with per-flow state (``transformWithState``, append mode: any sink).
    Only SYN / SYN-ACK rows reach the Python processor; ``max_wait`` bounds how long a SYN without an answer is
    kept. Rows without a timestamp or flow key are left out."""
    use_rocksdb(packets.sparkSession)
    syn, ack = flag(packets, "tcp_flags_syn"), flag(packets, "tcp_flags_ack")
    c = is_client(packets)
    d = with_event_time(packets).withWatermark("event_time", watermark)
    # The filter names the event time, so that it stays above the watermark: all packets move the clock.
    wanted = (F.upper(F.col("protocol")) == "TCP") & ((c & syn & ~ack) | (~c & syn & ack)) & F.col("event_time").isNotNull()
    d = with_oriented_key(d).where(F.coalesce(wanted & all_not_null(FLOW_KEY), F.lit(False)))
    d = d.select(*FLOW_KEY, "event_time", F.col("frame_number").cast("long").alias("frame_number"),
                 F.col("timestamp").cast("double").alias("ts"), (is_client(packets) & syn & ~ack).alias("is_syn"),
                 F.coalesce(opt(packets, "tcp_sequence_number", "long").cast("long"), F.lit(0).cast("long")).alias("seq"),
                 F.coalesce(opt(packets, "tcp_acknowledgment_number", "long").cast("long"), F.lit(-1).cast("long")).alias("ack"))
    return d.groupBy(*FLOW_KEY).transformWithState(
        statefulProcessor=HandshakeRtt(max_wait), outputStructType=_RTT_OUT, outputMode="Append", timeMode="EventTime")


def start_to_parquet(sdf: DataFrame, out_path: str, name: str, mode: str = "append",
                     available_now: bool = False, processing_time: str | None = None):
    """Start a streaming job into a Parquet folder. Its checkpoint lives under the cluster's
    shared ``spark.checkpoint.dir`` (``<dir>/streams/<name>``), so a restarted driver resumes
    exactly where it stopped; a local folder is only chosen when the setting is unset (tests)."""
    import os

    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(sdf.sparkSession)
    w = (sdf.writeStream.format("parquet").outputMode(mode).option("path", out_path)
         .option("checkpointLocation", os.path.join(base, "streams", name)).queryName(name))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


_DNS_OUT = T.StructType([T.StructField("frame_number", T.LongType()), T.StructField("client", T.StringType()),
                         T.StructField("sni", T.StringType()), T.StructField("server", T.StringType()),
                         T.StructField("mismatch", T.BooleanType())])


class DnsSni(StatefulProcessor):
    """Per client, name and slot of ``max_age`` seconds: rows are appended to list state until the watermark passes the
    slot's end, where one timer takes them in event-time order (answers before connections of the same time); then the
    state goes. A slot holds the DNS rows of two slots and the connections of one."""

    def __init__(self, max_age: float):
        self.max_age = max_age

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "t double, kind int, frame long, dst string, answers string")

    def handleInputRows(self, key, rows, timerValues):
        self.rows.appendList([(float(r.t), int(r.kind), int(r.frame), r.dst, r.answers) for r in rows])
        self.handle.registerTimer(_due_ms((key[2] + 1) * self.max_age))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        client, name, _ = key
        rows = list(self.rows.get()) if self.rows.exists() else []
        latest, seen = None, {}
        for t, kind, frame, dst, answers in sorted(rows, key=lambda r: tuple(r)[:3]):
            if kind == 0:
                for ip in filter(None, (answers or "").split(",")):
                    latest = seen[ip] = t
            elif latest is not None and t - latest <= self.max_age:
                yield Row(*_DNS_OUT.names)(frame, client, name, dst, not (dst in seen and t - seen[dst] <= self.max_age))
        self.rows.clear()

    def close(self) -> None:
        pass


def streaming_dns_sni(packets: DataFrame, watermark: str = DEFAULT_WATERMARK,
                      max_age: int = DNS_TLS_MAX_AGE_SECONDS) -> DataFrame:
    """ST4: mismatch of each TLS row against the DNS answers of its (client, name) in the previous
    ``max_age`` seconds, without DNS×TLS pairs. Time is cut into slots of ``max_age``: a connection
    belongs to its own slot, a DNS row to its own and the next one, so that one slot holds all that
    its connections need. Same rows as the batch check (``transformWithState``, append mode: any sink)."""
    use_rocksdb(packets.sparkSession)
    if "dns_response_addresses" in packets.columns:
        ans = dns_answers(F.col("dns_response_addresses"), is_array=True)
    else:
        ans = dns_answers(F.col("dns_response_addresses_csv"))
    d = with_event_time(packets).withColumns({"t": F.col("timestamp").cast("double"), "frame": F.col("frame_number").cast("long")})
    slot = F.floor(F.col("t") / F.lit(float(max_age))).cast("long")
    none = F.lit(None).cast("string")
    dns = d.where((F.col("destination_port") == 53) & F.col("dns_query_name").isNotNull() & F.col("source_ip").isNotNull()).select(
        F.col("source_ip").alias("client"), F.col("dns_query_name").alias("name"), F.explode(F.array(slot, slot + 1)).alias("slot"),
        "event_time", "t", F.lit(0).alias("kind"), "frame", none.alias("dst"), F.array_join(ans, ",").alias("answers"))
    tls = d.where((F.col("destination_port") == 443) & F.col("sni").isNotNull() & F.col("source_ip").isNotNull()).select(
        F.col("source_ip").alias("client"), F.col("sni").alias("name"), slot.alias("slot"),
        "event_time", "t", F.lit(1).alias("kind"), "frame", F.col("destination_ip").alias("dst"), none.alias("answers"))
    u = dns.unionByName(tls).withWatermark("event_time", watermark)
    return u.groupBy("client", "name", "slot").transformWithState(
        statefulProcessor=DnsSni(float(max_age)), outputStructType=_DNS_OUT, outputMode="Append", timeMode="EventTime")
