"""Streaming jobs against their batch operators (trigger availableNow from a Parquet folder)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from netflow_spark.fixtures import packets
from netflow_spark.operators import dns, metrics, ordered
from netflow_spark.streaming import jobs
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def stream_dir(spark):
    """Packets as a Parquet folder: the data file, then a file of closing rows far in the future
    so every append-mode window closes (watermark 1 hour)."""
    base = tempfile.mkdtemp(prefix="netflow-stream-", dir="/tmp")
    p = packets(spark, SF_SMALL)
    p.coalesce(1).write.mode("overwrite").parquet(os.path.join(base, "in"))
    mx = p.agg(F.max("timestamp")).first()[0] + 7200
    closing = p.where("frame_number IN (1, 24)").withColumn("timestamp", F.lit(mx)).withColumn(
        "frame_number", F.col("frame_number") + 10_000_000)
    closing.coalesce(1).write.mode("append").parquet(os.path.join(base, "in"))
    return base, p.schema, mx


def run(spark, sdf, name, mode="append"):
    q = (sdf.writeStream.format("memory").queryName(name).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name)


def source(spark, stream_dir):
    base, schema, _ = stream_dir
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(base, "in"))


def test_streaming_timeline_matches_batch(spark, stream_dir):
    out = run(spark, jobs.streaming_timeline(source(spark, stream_dir)), "st1")
    batch = metrics.timeline(packets(spark, SF_SMALL))
    assert out.count() == batch.count() == 63
    assert out.exceptAll(batch.select(*out.columns)).count() == 0


def test_streaming_handshake_rtt_matches_batch(spark, stream_dir):
    out = run(spark, jobs.streaming_handshake_rtt(source(spark, stream_dir)), "st3")
    batch = ordered.handshake_rtt(packets(spark, SF_SMALL))
    assert out.count() == batch.count()
    assert out.select(*batch.columns).exceptAll(batch).count() == 0


def test_streaming_flow_table_matches_batch(spark, stream_dir):
    """With a 30-minute session gap every flow of the view is one session, so the streaming
    table equals the batch flow table."""
    from netflow_spark.operators.flow_table import flow_table
    out = run(spark, jobs.streaming_flow_table(source(spark, stream_dir), gap="30 minutes"), "st2")
    assert out.agg(F.sum("pkts_total")).first()[0] == 1000
    batch = flow_table(packets(spark, SF_SMALL)).select(*out.columns)
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_streaming_rule_tagging_matches_batch(spark, stream_dir):
    """Stateless projections (rule pack, vendor flags, error reason) run unchanged on a stream."""
    from netflow_spark.functions.classify import packet_error_reason
    from netflow_spark.functions.net import vendor_ip_flags
    from netflow_spark.rules import default_rules, tag

    def project(df):
        df = vendor_ip_flags(df).withColumn("packet_error_reason", packet_error_reason(df))
        return tag(df, default_rules()).select("frame_number", "flow_disposition", "traffic_type_guess",
                                               "zscaler_specific_finding", "packet_error_reason")
    out = run(spark, project(source(spark, stream_dir)), "st_rules")
    batch = project(packets(spark, SF_SMALL))
    assert out.where("frame_number < 10000000").exceptAll(batch).count() == 0
    assert batch.exceptAll(out).count() == 0


def test_start_to_parquet_resumes(spark, stream_dir, tmp_path):
    out = str(tmp_path / "timeline")
    q = jobs.start_to_parquet(jobs.streaming_timeline(source(spark, stream_dir)), out, "tl_parquet",
                              available_now=True)
    q.awaitTermination(300)
    assert spark.read.parquet(out).count() == 63
    q2 = jobs.start_to_parquet(jobs.streaming_timeline(source(spark, stream_dir)), out, "tl_parquet",
                               available_now=True)
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == 63  # resumed from the checkpoint: nothing re-emitted


def test_streaming_dns_sni_matches_batch(spark, stream_dir):
    out = run(spark, jobs.streaming_dns_sni(source(spark, stream_dir)), "st4s")
    batch = dns.dns_sni_checks(packets(spark, SF_SMALL))
    assert out.count() == batch.count() == 26
    assert out.select(*batch.columns).exceptAll(batch).count() == 0


def test_stateful_streaming_matches_batch_on_random_packets(spark, tmp_path):
    """ST3 and ST4 equal their batch operators on a random packet table."""
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
    from random_packets import write
    src = str(tmp_path / "rand.parquet")
    write(src, 800, 5)
    p = spark.read.parquet(src)
    base = str(tmp_path / "in")
    p.coalesce(1).write.parquet(base)
    mx = p.agg(F.max("timestamp")).first()[0] + 7200
    closing = p.orderBy("frame_number").limit(50).withColumn("timestamp", F.lit(mx)).withColumn(
        "frame_number", F.col("frame_number") + 10_000_000)
    closing.coalesce(1).write.mode("append").parquet(base)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(base)
    st3 = run(spark, jobs.streaming_handshake_rtt(stream), "st3_rand").where("frame_number < 10000000")
    b3 = ordered.handshake_rtt(p)
    assert st3.select(*b3.columns).exceptAll(b3).count() == 0 and b3.exceptAll(st3.select(*b3.columns)).count() == 0
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(base)
    st4 = run(spark, jobs.streaming_dns_sni(stream), "st4_rand")
    b4 = dns.dns_sni_checks(p)
    assert b4.count() > 0
    assert st4.select(*b4.columns).exceptAll(b4).count() == 0 and b4.exceptAll(st4.select(*b4.columns)).count() == 0


def test_samples_across_many_micro_batches(spark, tmp_path):
    """One file per micro-batch, rows out of order between files: ST3 and ST4 still equal the batch operators."""
    p = packets(spark, SF_SMALL)
    base = str(tmp_path / "in")
    for i in (1, 0, 3, 2, 4, 5):
        p.where(f"frame_number % 6 = {i}").coalesce(1).write.mode("append").parquet(base)
    mx = p.agg(F.max("timestamp")).first()[0] + 7200
    for k in (1, 2):
        p.where("frame_number IN (1, 24)").withColumn("timestamp", F.lit(mx * 1.0 + k)).withColumn(
            "frame_number", F.col("frame_number") + 10_000_000 * k).coalesce(1).write.mode("append").parquet(base)

    def stream():
        return spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(base)
    b3 = ordered.handshake_rtt(p)
    st3 = run(spark, jobs.streaming_handshake_rtt(stream()), "st3_many").where("frame_number < 10000000").select(*b3.columns)
    assert b3.count() > 0 and st3.exceptAll(b3).count() == 0 and b3.exceptAll(st3).count() == 0
    b4 = dns.dns_sni_checks(p)
    st4 = run(spark, jobs.streaming_dns_sni(stream()), "st4_many").where("frame_number < 10000000").select(*b4.columns)
    assert st4.exceptAll(b4).count() == 0 and b4.exceptAll(st4).count() == 0


def test_late_answer_in_a_later_batch(spark, tmp_path):
    """A SYN in the first file and its SYN-ACK in the fourth give one sample."""
    schema = ("frame_number long, timestamp double, source_ip string, destination_ip string, source_port long, destination_port long, protocol string, "
              "is_source_client boolean, tcp_flags_syn boolean, tcp_flags_ack boolean, tcp_sequence_number long, tcp_acknowledgment_number long")
    base = str(tmp_path / "in")
    rows = [(1, 500.0, "a", "b", 7, 80, "TCP", True, True, False, 41, None), (2, 501.0, "c", "d", 7, 80, "TCP", True, True, False, 1, None),
            (3, 502.0, "e", "f", 7, 80, "TCP", True, True, False, 1, None), (4, 502.5, "b", "a", 80, 7, "TCP", False, True, True, 9, 42),
            (5, 9999.0, "x", "y", 7, 80, "TCP", True, True, False, 1, None), (6, 19999.0, "x", "y", 7, 80, "TCP", True, True, False, 1, None)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(base)
    stream = spark.readStream.schema(spark.read.parquet(base).schema).option("maxFilesPerTrigger", 1).parquet(base)
    got = run(spark, jobs.streaming_handshake_rtt(stream), "st3_late").collect()
    assert [(r.client_ip, r.frame_number, r.rtt_ms) for r in got] == [("a", 4, 2500.0)]


@pytest.mark.parametrize("job", ["rtt", "dns"])
def test_stateful_jobs_are_stored_and_resume(spark, tmp_path, job):
    """ST3 and ST4 through the Parquet runner: stopped half way, started again from the checkpoint, equal to batch."""
    p = packets(spark, SF_SMALL)
    base, out = str(tmp_path / "in"), str(tmp_path / "out")
    make, batch = ((jobs.streaming_handshake_rtt, ordered.handshake_rtt) if job == "rtt" else (jobs.streaming_dns_sni, dns.dns_sni_checks))
    mx = p.agg(F.max("timestamp")).first()[0] + 7200

    def run_all():
        stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(base)
        q = jobs.start_to_parquet(make(stream), out, f"stored_{job}_{os.path.basename(tmp_path)}", available_now=True)
        q.awaitTermination(300)
        return [x["batchId"] for x in q.recentProgress]
    for i in (2, 0):
        p.where(f"frame_number % 4 = {i}").coalesce(1).write.mode("append").parquet(base)
    first = run_all()
    for i in (3, 1):
        p.where(f"frame_number % 4 = {i}").coalesce(1).write.mode("append").parquet(base)
    for k in (1, 2):
        p.where("frame_number IN (1, 24)").withColumn("timestamp", F.lit(mx * 1.0 + k)).withColumn(
            "frame_number", F.col("frame_number") + 10_000_000 * k).coalesce(1).write.mode("append").parquet(base)
    later = run_all()
    assert len(first) >= 2 and len(later) >= 4 and min(later) > max(first)
    want = batch(p)
    got = spark.read.parquet(out).where("frame_number < 10000000").select(*want.columns)
    assert want.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_syn_without_answer_goes(spark, tmp_path):
    """An answer that comes later than ``max_wait`` finds no SYN; the state of the flow is empty then."""
    schema = ("frame_number long, timestamp double, source_ip string, destination_ip string, source_port long, destination_port long, protocol string, "
              "is_source_client boolean, tcp_flags_syn boolean, tcp_flags_ack boolean, tcp_sequence_number long, tcp_acknowledgment_number long")
    base = str(tmp_path / "in")
    rows = [(1, 100.0, "a", "b", 7, 80, "TCP", True, True, False, 41, None), (2, 5000.0, "x", "y", 7, 80, "TCP", True, True, False, 1, None),
            (3, 5001.0, "x", "y", 7, 80, "TCP", True, True, False, 1, None), (4, 4990.0, "b", "a", 80, 7, "TCP", False, True, True, 9, 42),
            (5, 5002.0, "c", "d", 7, 80, "TCP", True, True, False, 8, None), (6, 5003.5, "d", "c", 80, 7, "TCP", False, True, True, 9, 9),
            (7, 9999.0, "x", "y", 7, 80, "TCP", True, True, False, 1, None)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(base)
    stream = spark.readStream.schema(spark.read.parquet(base).schema).option("maxFilesPerTrigger", 1).parquet(base)
    got = run(spark, jobs.streaming_handshake_rtt(stream, watermark="1 minute", max_wait=10.0), "st3_gone").collect()
    assert [(r.client_ip, r.frame_number, r.rtt_ms) for r in got] == [("c", 6, 1500.0)]
