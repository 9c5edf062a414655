"""Hot keys: one key holding every row, tiny blocks — results must equal a direct simulation."""

import random
from collections import deque

from netflow_spark.operators.asof import asof_latest
from netflow_spark.operators.ordered import tcp_heuristics


def _simulate_w1(rows):
    hist = deque(maxlen=64)
    out = {}
    for frame, seq, ack, win, ln in rows:
        seqs = {h[0] for h in hist if h[0] is not None}
        r = seq is not None and seq in seqs
        d = o = z = False
        if hist:
            last = hist[-1]
            d = ack is not None and ack == last[1] and ln == 0
            if seq is not None:
                o = seq < (last[0] or 0) + (last[3] or 0) and seq not in seqs
            z = win == 0 and last[2] not in (None, 0)
        hist.append((seq, ack, win, ln))
        out[frame] = (r, d, o, z)
    return out


def test_w1_single_hot_key_tiny_blocks(spark):
    rnd = random.Random(5)
    rows = []
    for f in range(1, 1501):
        rows.append((f, rnd.choice([None] + list(range(0, 4000, 100))), rnd.choice([None, 1, 2, 3]),
                     rnd.choice([None, 0, 0, 512]), rnd.choice([0, 0, 100])))
    df = spark.createDataFrame(
        [(f, 1.0, "10.0.0.1", "10.0.0.2", 1234, 80, "TCP", s, a, w, ln) for f, s, a, w, ln in rows],
        "frame_number long, timestamp double, source_ip string, destination_ip string, source_port long, "
        "destination_port long, protocol string, tcp_sequence_number long, tcp_acknowledgment_number long, "
        "tcp_window_size long, tcp_payload_length long").repartition(7)
    expected = _simulate_w1(rows)
    for block in (50, 1 << 20):
        got = {r.frame_number: (r.heuristic_retransmission, r.heuristic_duplicate_ack, r.heuristic_out_of_order,
                                r.heuristic_zero_window) for r in tcp_heuristics(df, block=block).collect()}
        assert got == expected, block


def test_asof_single_hot_key_tiny_blocks(spark):
    rnd = random.Random(9)
    frames = list(range(1, 3001))
    build = [(f, f * 10) for f in frames if rnd.random() < 0.2]
    probes = [f for f in frames if rnd.random() < 0.1]
    bset = dict(build)
    b = spark.createDataFrame([("k", f, v) for f, v in build], "key string, frame long, val long")
    p = spark.createDataFrame([("k", f) for f in probes], "key string, frame long")
    for strict in (True, False):
        exp = {}
        for f in probes:
            cands = [g for g in bset if (g < f if strict else g <= f)]
            exp[f] = bset[max(cands)] if cands else None
        for block in (7, 1 << 20):
            got = {r.frame: r.val for r in asof_latest(p, b, ["key"], "frame", "val", block=block, strict=strict).collect()}
            assert got == exp, (strict, block)
