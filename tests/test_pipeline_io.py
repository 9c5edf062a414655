"""Pipelines (U1–U3), the metrics bundle (A18) and sources/sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from netflow_spark.fixtures import networks, packets, two_captures
from netflow_spark.plans.bundle import bundle_json, metrics_bundle
from netflow_spark.plans.steps import StepError, parse_steps, read_steps, run_steps
from netflow_spark.sources import io
from tests.captures import PRINTER, office
from tests.conftest import SF_SMALL


def test_steps_from_files(spark, tmp_path):
    yaml_file, json_file = tmp_path / "run.yml", tmp_path / "run.json"
    yaml_file.write_text("processors: [vendor_ip_flags, {name: fill_ints}]\nanalyzers:\n- tagged_flows\nreporters:\n- {name: error_summary, params: {k: 1}}\n")
    json_file.write_text(json.dumps({"analyzers": ["flow_table"], "reporters": [{"name": "top_by_bytes", "params": {"n": 4}}]}))
    progress = []
    steps = read_steps(yaml_file)
    assert [(kind, s.name) for kind, s in steps] == [("processors", "vendor_ip_flags"), ("processors", "fill_ints"), ("analyzers", "tagged_flows"), ("reporters", "error_summary")]
    out = run_steps(packets(spark, SF_SMALL), steps, lambda done, of: progress.append(f"{done}/{of}"))
    assert all(len(r.sample_flow_ids) == 1 for r in out.collect()) and progress == ["1/4", "2/4", "3/4", "4/4"]
    assert run_steps(packets(spark, SF_SMALL), read_steps(str(json_file))).count() == 4


@pytest.mark.parametrize("config", [
    {"processors": ["subprocess.run"]}, {"analyzers": ["vendor_ip_flags"]}, {"reporters": [{"params": {}}]}, {"reporters": [None]},
    {"reporters": [{"name": "top_by_bytes", "params": {"rows": 3}}]}, ["orient"]])
def test_step_lists_that_are_refused(config):
    with pytest.raises(StepError):
        parse_steps(config)


def test_step_file_of_another_kind(tmp_path):
    other = tmp_path / "run.toml"
    other.write_text("")
    with pytest.raises(StepError):
        read_steps(other)


def test_metrics_bundle(spark):
    b = metrics_bundle(packets(spark, SF_SMALL), networks=networks(spark, SF_SMALL),
                       service_guesser=lambda df: F.lit("svc"))
    assert b["timeline_data"].count() == 63 and b["timeline_data"].where("spike").count() == 3
    assert [r.service for r in b["service_overview"].collect()] == ["svc"]
    assert b["top_talkers_by_bytes"].count() == 20
    assert b["connections_to_unusual_countries"].count() > 0
    records = bundle_json(b)
    assert {r.report for r in records.select("report").distinct().collect()} == {k for k, df in b.items() if df.take(1)}
    spikes = [json.loads(r.record) for r in records.where("report = 'timeline_data'").collect()]
    assert sum(bool(x.get("top_flows")) for x in spikes) == 3 and all(len(x.get("top_flows", [])) <= 5 for x in spikes)


def test_bundle_of_two_captures(spark):
    """Every report has the capture, and each capture's part equals its own bundle."""
    both = metrics_bundle(two_captures(spark, SF_SMALL), keys=["capture_id"], networks=networks(spark, SF_SMALL))
    alone = metrics_bundle(two_captures(spark, SF_SMALL).where("capture_id = 'b'").drop("capture_id"), networks=networks(spark, SF_SMALL))
    for name, df in alone.items():
        if name == "flow_dispositions":
            continue  # hashed ids cover the capture
        mine = both[name].where("capture_id = 'b'").select(*df.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, df.collect())), name


def test_read_write_roundtrip(spark, tmp_path):
    p = packets(spark, SF_SMALL).select("frame_number", "source_ip", "destination_ip", "source_port",
                                        "destination_port", "protocol")
    for ext in ("parquet", "csv", "json"):
        path = str(tmp_path / f"flows.{ext}")
        io.write_flows(p, path)
        back = io.read_flows(spark, path)
        assert back.count() == 1000
    with pytest.raises(ValueError):
        io.write_flows(p, str(tmp_path / "x.xlsx"))
    pk = io.read_packets(spark, str(tmp_path / "flows.csv"))
    assert pk.count() == 1000 and "tcp_flags_syn" not in pk.columns and dict(pk.dtypes)["source_port"] == "bigint"
    assert "tcp_flags_syn" in io.read_packets(spark, str(tmp_path / "flows.csv"), fill=True).columns
    array = tmp_path / "array.json"
    array.write_text('\n [{"a": 1},\n {"a": 2}]\n')
    assert sorted(r.a for r in io.read_flows(spark, str(array)).collect()) == [1, 2]


def test_export_by_protocol_and_records(spark, tmp_path):
    s = spark.createDataFrame([("TCP", 1), ("", 2), (None, 3)], "protocol string, n long")
    io.export_by_protocol(s, str(tmp_path / "by_proto"))
    dirs = sorted(d for d in os.listdir(tmp_path / "by_proto") if d.startswith("protocol="))
    assert dirs == ["protocol=TCP", "protocol=UNKNOWN"]
    rec = io.export_records(s, {"filename": "x.pcap"}).first()
    assert json.loads(rec.record)["n"] == 1 and json.loads(rec.capture_info) == {"filename": "x.pcap"}


def test_slice_frames_and_save(spark, tmp_path):
    p = packets(spark, SF_SMALL)
    sl = io.slice_frames(p, start=10, size=20, max_packets=5).collect()
    assert [r.frame_number for r in sl] == [11, 12, 13, 14, 15]
    io.save_packets(p, str(tmp_path / "store"))
    io.save_packets(p, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2000


def test_command_line(spark, tmp_path):
    import netflow_spark
    from netflow_spark.__main__ import main
    src, out = str(tmp_path / "in.parquet"), str(tmp_path / "tagged.parquet")
    office().frame(spark).drop("is_source_client").write.parquet(src)
    assert main(["tag", "--in", src, "--out", out], spark=spark) == 0
    assert "Blocked - Proxy Authentication Failed" in {r.flow_disposition for r in spark.read.parquet(out).collect()}
    bad = tmp_path / "bad.yaml"
    bad.write_text("labels: [unclosed")
    assert main(["tag", "--rules", str(bad), "--in", src, "--out", out], spark=spark) == 1
    assert main(["flows", "--in", src, "--out", str(tmp_path / "f.parquet")], spark=spark) == 0
    flows = {r.server_ip: r.flow_disposition for r in spark.read.parquet(str(tmp_path / "f.parquet")).collect()}
    assert flows[PRINTER] == "Allowed"  # directions were found from the packets
    assert callable(netflow_spark.tag_flows) and callable(netflow_spark.run_steps)


def test_captures_to_table_and_report(spark, tmp_path, capsys):
    """``parse`` appends captures to one table; ``report`` writes every report of it."""
    import json

    from netflow_spark.__main__ import main
    from netflow_spark.plans.bundle import metrics_bundle
    from netflow_spark.operators.orient import ensure_direction
    from tests.test_capture import _frames, pcap, pcapng
    folder, table, report = tmp_path / "captures", str(tmp_path / "packets.parquet"), str(tmp_path / "report")
    folder.mkdir()
    (folder / "a.pcap").write_bytes(pcap(_frames()))
    (folder / "b.pcapng").write_bytes(pcapng(_frames()[:3]))
    assert main(["parse", "--in", str(folder), "--out", table], spark=spark) == 0
    more = tmp_path / "c.pcap"
    more.write_bytes(pcap(_frames()) + b"\1\2\3")
    assert main(["parse", "--in", str(more), "--out", table], spark=spark) == 1
    assert "CaptureError" in capsys.readouterr().err
    assert main(["parse", "--in", str(more), "--out", table, "--on-bad", "skip"], spark=spark) == 0
    stored = io.read_packets(spark, table)
    n = len(_frames())
    assert sorted(r["count"] for r in stored.groupBy("capture_file").count().collect()) == [3, n, n] and "data" not in stored.columns
    assert main(["report", "--in", table, "--out", report, "--keys", "capture_file"], spark=spark) == 0
    written = spark.read.option("wholetext", False).text(report)
    bundle = metrics_bundle(ensure_direction(stored, ["capture_file"]), keys=["capture_file"])
    counts = {r["report"]: r["count"] for r in written.groupBy("report").count().collect()}
    for name in ("capture_info", "protocols", "flow_dispositions", "timeline_data"):
        assert counts[name] == bundle[name].count()
    infos = [json.loads(r.value) for r in written.where("report = 'capture_info'").collect()]
    assert len(infos) == 3 and all(i["capture_file"] for i in infos)


def test_numbers_given_to_frames_are_one_set(spark, tmp_path):
    """Packets without frame numbers get them once, whichever branch of a plan reads them."""
    from netflow_spark.__main__ import _packets
    src = str(tmp_path / "in.parquet")
    office().frame(spark).drop("frame_number").repartition(5).write.parquet(src)
    p = _packets(spark, src, [])
    a, b = (p.repartition(k).select("frame_number", "timestamp", "source_ip").distinct() for k in (1, 3))
    assert a.count() == p.count() and a.exceptAll(b).count() == 0


def test_read_packets_json(spark, tmp_path):
    p = tmp_path / "pk.json"
    p.write_text('{"frame_number": 1, "timestamp": 1.5, "source_ip": "10.0.0.1", "destination_ip": "8.8.8.8", '
                 '"source_port": 5000, "destination_port": 53, "protocol": "UDP", '
                 '"dns_response_addresses": ["1.2.3.4", "5.6.7.8"], "tcp_flags_syn": null}\n'
                 '{"frame_number": 2, "timestamp": 2.0, "source_ip": "8.8.8.8", "destination_ip": "10.0.0.1", '
                 '"protocol": "UDP", "extra_field": "kept"}\n')
    df = io.read_packets(spark, str(p))
    types = dict(df.dtypes)
    assert types["dns_response_addresses"] == "array<string>" and types["frame_number"] == "bigint"
    assert "http_response_code" not in types and types["packet_length"] == "bigint" and "extra_field" in df.columns
    rows = df.orderBy("frame_number").collect()
    assert rows[0].dns_response_addresses == ["1.2.3.4", "5.6.7.8"] and rows[1].source_port is None
