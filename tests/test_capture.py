"""Capture ingest (S2/S3): framing by the Python data source, header decoding natively."""

import struct

import pytest
from pyspark.sql import functions as F

from netflow_spark.sources.capture import decode_frames, ipv6_text, read_capture_frames, register, valid_captures


def _ip4(s):
    return bytes(int(x) for x in s.split("."))


def _eth(payload, et=0x0800):
    return bytes.fromhex("020000000002") + bytes.fromhex("020000000001") + struct.pack(">H", et) + payload


def _ipv4(src, dst, proto, payload, ip_id=7):
    total = 20 + len(payload)
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, total, ip_id, 0x4000, 64, proto, 0, _ip4(src), _ip4(dst)) + payload


def _tcp(sport, dport, seq, ack, flags, payload=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 5 << 4, flags, 65535, 0, 0) + payload


def _udp(sport, dport, payload=b""):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def _frames():
    syn = _eth(_ipv4("10.0.0.1", "10.0.0.2", 6, _tcp(1234, 80, 100, 0, 0x02), ip_id=100))
    synack = _eth(_ipv4("10.0.0.2", "10.0.0.1", 6, _tcp(80, 1234, 500, 101, 0x12)))
    data = _eth(_ipv4("10.0.0.1", "10.0.0.2", 6, _tcp(1234, 80, 101, 501, 0x18, b"GET / HTTP/1.1\r\n")))
    quoted = _ipv4("10.0.0.1", "10.0.0.2", 6, _tcp(1234, 80, 100, 0, 0x02), ip_id=100)[:28]
    icmp = _eth(_ipv4("9.9.9.9", "10.0.0.1", 1, struct.pack(">BBHI", 11, 0, 0, 0) + quoted))
    v6 = _eth(struct.pack(">IHBB", 0x60000000, 8, 17, 64) + bytes.fromhex("20010db8" + "0" * 23 + "1")
              + bytes.fromhex("20010db8" + "0" * 23 + "2") + _udp(5353, 53), et=0x86DD)
    return [syn, synack, data, icmp, v6]


def _v6(next_header, payload, src="20010db8000000000000000000000001", dst="20010db8000100000000000000000002"):
    return struct.pack(">IHBB", 0x60000000, len(payload), next_header, 64) + bytes.fromhex(src) + bytes.fromhex(dst) + payload


def pcap(frames, link=1, e="<", magic=0xA1B2C3D4, frac=250000):
    out = struct.pack(e + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    return out + b"".join(struct.pack(e + "IIII", 1000 + i, frac, len(f), len(f)) + f for i, f in enumerate(frames))


def pcapng(frames, e="<", link=1, first=2000):
    def block(btype, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(e + "II", btype, 12 + len(body)) + body + struct.pack(e + "I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack(e + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(e + "HHI", link, 0, 65535))
    for i, f in enumerate(frames):
        ts = (first + i) * 1_000_000
        out += block(6, struct.pack(e + "IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def read(spark, tmp_path, content, **kw):
    path = tmp_path / f"c{abs(hash(content))}.cap"
    path.write_bytes(content)
    return read_capture_frames(spark, str(path), **kw).orderBy("frame_number").collect()


def test_folder_of_captures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(_frames()))
    (tmp_path / "b.pcapng").write_bytes(pcapng(_frames()[:2]))
    (tmp_path / "notes.txt").write_bytes(b"shopping list")
    valid = {r.path.rsplit("/", 1)[1]: r.valid for r in valid_captures(spark, str(tmp_path)).collect()}
    assert valid == {"a.pcap": True, "b.pcapng": True, "notes.txt": False}
    with pytest.raises(Exception, match="not a capture file"):
        read_capture_frames(spark, str(tmp_path)).collect()
    rows = read_capture_frames(spark, str(tmp_path), on_bad="skip").orderBy("capture_file", "frame_number").collect()
    syn, synack, data, icmp, v6, first, second = rows
    assert (syn.source_ip, syn.destination_ip, syn.source_port, syn.destination_port) == ("10.0.0.1", "10.0.0.2", 1234, 80)
    assert syn.protocol == "TCP" and syn.tcp_flags_syn and not syn.tcp_flags_ack and syn.ip_id == 100
    assert synack.tcp_flags_syn and synack.tcp_flags_ack and synack.tcp_acknowledgment_number == 101
    assert data.tcp_flags_psh and data.tcp_payload_length == 16
    assert syn.timestamp == 1000.25 and syn.source_mac == "02:00:00:00:00:01"
    assert (icmp.protocol, icmp.icmp_type, icmp.icmp_original_destination_ip, icmp.icmp_original_ip_id,
            icmp.icmp_original_protocol, icmp.icmp_original_destination_port) == ("ICMP", 11, "10.0.0.2", 100, "TCP", 80)
    assert (v6.protocol_l3, v6.protocol, v6.destination_port, v6.source_ip) == ("IPv6", "UDP", 53, "2001:db8::1")
    assert first.timestamp == 2000.0 and second.tcp_flags_ack


def test_split_reading_and_the_data_source_agree(spark, tmp_path):
    frames = _frames() * 40
    (tmp_path / "a.pcap").write_bytes(pcap(frames))
    (tmp_path / "b.pcapng").write_bytes(pcapng(frames[:60]))
    # a second section in the other byte order, inside of what one range holds
    (tmp_path / "c.pcapng").write_bytes(pcapng(frames[:7]) + pcapng(frames[:30], ">", first=3000) + pcapng(frames[:3]))
    register(spark)
    whole = decode_frames(spark.read.format("capture").load(str(tmp_path)))
    cols = ["capture_file", "frame_number", "timestamp", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "packet_length"]
    for size in (1500, 700, 128 << 20):
        split = read_capture_frames(spark, str(tmp_path), split_bytes=size)
        assert split.count() == 300 and whole.select(*cols).exceptAll(split.select(*cols)).count() == 0
    stored = read_capture_frames(spark, f"file:///{str(tmp_path).lstrip('/')}")
    assert stored.count() == 300


@pytest.mark.parametrize("e,magic,frac", [(">", 0xA1B2C3D4, 250000), ("<", 0xA1B23C4D, 250000000), (">", 0xA1B23C4D, 250000000)])
def test_byte_orders_and_nanoseconds(spark, tmp_path, e, magic, frac):
    rows = read(spark, tmp_path, pcap(_frames()[:3], 1, e, magic, frac), split_bytes=100)
    assert [r.timestamp for r in rows] == [1000.25, 1001.25, 1002.25] and [r.tcp_flags_syn for r in rows] == [True, True, False]


def test_later_fragments_have_no_ports(spark, tmp_path):
    whole = _ipv4("10.9.0.1", "10.9.0.2", 17, _udp(7000, 8000, b"x" * 16))
    first = whole[:6] + struct.pack(">H", 0x2000) + whole[8:]
    later = whole[:6] + struct.pack(">H", 0x0002) + whole[8:20] + bytes.fromhex("deadbeef") * 6
    a, b = read(spark, tmp_path, pcap([_eth(first), _eth(later)]))
    assert (a.source_port, a.destination_port) == (7000, 8000)
    assert (b.protocol, b.source_ip, b.source_port, b.destination_port) == ("UDP", "10.9.0.1", None, None)
    frag6 = _eth(_v6(44, struct.pack(">BBHI", 17, 0, 0, 9) + _udp(7000, 8000)), 0x86DD)
    later6 = _eth(_v6(44, struct.pack(">BBHI", 17, 0, 16, 9) + b"z" * 16), 0x86DD)
    c, d = read(spark, tmp_path, pcap([frag6, later6]))
    assert (c.protocol, c.source_port) == ("UDP", 7000) and (d.protocol, d.source_port) == ("UDP", None)


def test_ipv6_extension_headers(spark, tmp_path):
    options = lambda nxt, blocks: struct.pack(">BB", nxt, blocks) + b"\0" * (6 + 8 * blocks)
    chain = options(43, 1) + options(60, 0) + options(51, 2) + struct.pack(">BB", 6, 4) + b"\0" * 22 + _tcp(5555, 25, 1, 2, 0x12)
    r, = read(spark, tmp_path, pcap([_eth(_v6(0, chain), 0x86DD)]))
    assert (r.protocol, r.source_port, r.destination_port, r.tcp_flags_syn, r.tcp_payload_length) == ("TCP", 5555, 25, True, 0)


@pytest.mark.parametrize("link,wrap", [
    (101, lambda ip: ip), (0, lambda ip: struct.pack("<I", 2) + ip), (113, lambda ip: b"\0" * 14 + struct.pack(">H", 0x0800) + ip),
    (276, lambda ip: struct.pack(">H", 0x0800) + b"\0" * 18 + ip), (1, lambda ip: _eth(struct.pack(">HH", 7, 0x0800) + ip, 0x8100)),
    (1, lambda ip: _eth(struct.pack(">HHHH", 7, 0x8100, 9, 0x0800) + ip, 0x88A8))])
def test_link_types(spark, tmp_path, link, wrap):
    r, = read(spark, tmp_path, pcap([wrap(_ipv4("10.8.0.1", "10.8.0.2", 6, _tcp(6666, 443, 1, 0, 2)))], link))
    assert (r.source_ip, r.destination_ip, r.protocol, r.destination_port, r.tcp_flags_syn) == ("10.8.0.1", "10.8.0.2", "TCP", 443, True)


def test_unknown_link_type_and_short_frames_give_nulls(spark, tmp_path):
    r, = read(spark, tmp_path, pcap([b"\x45" + b"\0" * 40], 147))
    assert (r.source_ip, r.protocol, r.packet_length) == (None, None, 41)
    whole = _eth(_ipv4("10.0.0.1", "10.0.0.2", 6, _tcp(1234, 80, 100, 0, 0x02)))
    rows = read(spark, tmp_path, pcap([whole[:n] for n in (0, 10, 20, 28, 33, 36, 40, len(whole))]))
    assert [r.source_ip for r in rows] == [None] * 3 + [None] + ["10.0.0.1"] * 4
    assert [r.destination_ip for r in rows] == [None] * 5 + ["10.0.0.2"] * 3
    assert [r.destination_port for r in rows] == [None] * 6 + [80] * 2 and [r.tcp_flags_syn for r in rows] == [None] * 7 + [True]


def test_addresses_as_canonical_text(spark):
    import ipaddress
    import random
    rng = random.Random(8)
    values = [0, 1, 1 << 127, 0xFFFF << 32, int(ipaddress.ip_address("2001:db8:0:0:1:0:0:1")), int(ipaddress.ip_address("1:0:2:0:3:0:0:4"))]
    values += [sum(rng.choice((0, 0, 0, rng.getrandbits(16), 1)) << 16 * i for i in range(8)) for _ in range(300)]
    df = spark.createDataFrame([(f"{v:032X}",) for v in values], "h string")
    got = [r.t for r in df.select(ipv6_text(F.col("h")).alias("t")).collect()]
    want = [str(ipaddress.ip_address(v)) for v in values]
    assert [g for g, w in zip(got, want) if "." not in w] == [w for w in want if "." not in w]


def test_truncated_files(spark, tmp_path):
    for content in (pcap(_frames())[:-5], pcapng(_frames())[:-20]):
        with pytest.raises(Exception, match="ends inside"):
            read(spark, tmp_path, content)
        assert len(read(spark, tmp_path, content, on_bad="skip")) == 4
    with pytest.raises(Exception, match="ends inside|not a capture"):
        read(spark, tmp_path, b"\xd4\xc3")


def test_files_that_break_off_in_a_header(spark, tmp_path):
    def frames(rows):
        return [{**r.asDict(), "capture_file": None} for r in rows]

    other = struct.pack("<II", 5, 32) + b"\0" * 9  # a statistics block, cut short
    for whole, tails in ((pcap(_frames()), [b"\1", b"\1" * 15]), (pcapng(_frames()), [b"\6" + b"\0" * 6, other])):
        want = frames(read(spark, tmp_path, whole))
        assert len(want) == len(_frames())
        for tail in tails:
            with pytest.raises(Exception, match="ends inside"):
                read(spark, tmp_path, whole + tail)
            for split in (64, 128 << 20):
                assert frames(read(spark, tmp_path, whole + tail, on_bad="skip", split_bytes=split)) == want
