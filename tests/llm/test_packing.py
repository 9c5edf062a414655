import random
import tracemalloc
import weakref
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import AWKWARD, docs
from tokenizers import Tokenizer

from netflow_spark.llm import packing, words
from netflow_spark.llm.common import arrow_batches
from netflow_spark.llm.packing import pack, plan_slots, reduce_dominated

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, room):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins) if b + items[i] <= room}.values():
            bins[k] += items[i]
            place(i + 1, bins)
            bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_an_optimum():
    rng = random.Random(5)
    for _ in range(1500):
        room = rng.choice([10, 13, 20, 30])
        items = [rng.randint(1, room) for _ in range(rng.randrange(1, 10))]
        count = {n: items.count(n) for n in items}
        fixed, rest = reduce_dominated(count, room)
        left = [n for n, c in rest.items() for _ in range(c)]
        assert sum(k for _, k in fixed) + (fewest(left, room) if left else 0) == fewest(items, room)


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    count = {n: rng.randrange(0, 50) for n in rng.sample(range(1, 4097), 600)}
    where, used = defaultdict(list), defaultdict(int)
    for n, first, last, sequence, per, offset in plan_slots(count):
        assert first == used[n]
        used[n] = last
        for k in range(first, last):
            where[sequence + (k - first) // per].append((offset + (k - first) % per * n, n))
    assert used == {n: c for n, c in count.items() if c}
    for pieces in where.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096
    at_least = max(sum(n * c for n, c in count.items()) / 4096, sum(c for n, c in count.items() if n > 2048))
    assert len(where) <= 1.05 * at_least + 1


def test_awkward_rows(spark):
    got = pack(docs(spark, AWKWARD), PATH, keep_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in AWKWARD:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(i, p, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096


def test_words_that_share_a_hash(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    texts = [a, a.translate(str.maketrans("ab", "ba"))]
    got = {r.doc_id: bytes(r.ids) for r in pack(docs(spark, list(enumerate(texts))), PATH, keep_ids=True).collect()}
    for i, e in enumerate(Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)):
        assert got[i] == np.array([*e.ids, 1], dtype="<u4").tobytes()


def test_empty(spark):
    assert pack(docs(spark, []), PATH).count() == 0


def test_a_task_takes_little_memory_beside_its_texts(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    def batch(texts):
        return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["_id", "_text"])

    monkeypatch.setattr(packing, "TaskContext", Task)
    rng = random.Random(4)
    words_ = ["".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words_, k=500)) for _ in range(1500)]
    run = packing._piece_maker(PATH, 4096, 1, False)
    assert sum(b.num_rows for b in run(iter([batch(texts[:1])]))) == 1
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in run(iter([batch(texts)]))) == len(texts)
        assert tracemalloc.get_traced_memory()[1] < 10 * sum(map(len, texts))
    finally:
        tracemalloc.stop()


def test_memory_is_released_after_the_last_array_has_gone(monkeypatch):
    alive = []

    def run(batches):
        for b in batches:
            held = np.zeros(b)
            alive.append(weakref.ref(held))
            yield b

    seen = []
    monkeypatch.setattr(words, "release", lambda: seen.append([r() is None for r in alive]))
    assert list(words.released(run)(iter([3, 4]))) == [3, 4]
    assert seen == [[True, True]]


def test_batches_are_small_only_while_packing(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    with pytest.raises(ValueError), arrow_batches(spark, 10):
        assert max(r.n for r in spark.range(100).coalesce(1).mapInArrow(rows, "n long").collect()) == 10
        raise ValueError
    assert spark.conf.get(key) == before
    pack(docs(spark, [(1, "a text")]), PATH).collect()
    assert spark.conf.get(key) == before
