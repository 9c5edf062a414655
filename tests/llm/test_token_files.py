import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import AWKWARD, docs
from tokenizers import Tokenizer

from netflow_spark.llm.common import new_folder
from netflow_spark.llm.encoding import TextEncoder, splits_known
from netflow_spark.llm.token_files import (FileReader, FileWriter, bits_for, pack_bits, read_documents, read_ids,
                                           unpack_bits, write_token_files)
from netflow_spark.llm.words import text_chunks

PATH, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
THUE = "a"
while len(THUE) < 2048:
    THUE += THUE.translate(str.maketrans("ab", "ba"))
ODD = ["", None, "a<|startoftext|>b  <|endoftext|>", "ΑΣ ΟΔΟΣ İstanbul  x y é ́z", "it's don't 'LL\x1c\x1d\x85 q　r 한글 가 ﬁ Å", "😀 힣",
       "<|startof a_b--c 12x3", THUE, THUE.translate(str.maketrans("ab", "ba"))]


def encoded(path, texts, cache=400_000):
    enc, got = TextEncoder(path, cache), []
    for _, part in text_chunks(pa.array(texts, pa.string())):
        ids, off = enc.encode(part)
        got += [ids[off[i]:off[i + 1]].tolist() for i in range(len(part))]
    return got


@pytest.mark.parametrize("cache", [400_000, 50])
def test_ids_are_the_librarys(cache):
    rng = random.Random(4)
    letters = "abAB cZ'sde rllvm 0123 <|>_-. \t\n\x0b\x1c\x00\x7f é Éßİ ſ ́ﬁ ñ ΑΣ 한 😀    "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(4000)] + ODD
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encoded(PATH, texts, cache) == want


def test_other_settings_go_through_the_library():
    assert splits_known(PATH) and not splits_known(BYTES)
    want = [e.ids for e in Tokenizer.from_file(BYTES).encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert encoded(BYTES, ODD) == want


@pytest.mark.parametrize("width", range(1, 33))
def test_every_width(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = pack_bits(ids, width)
        assert len(data) == (n * width + 7) // 8
        assert unpack_bits(data, width, n).tolist() == ids.tolist()
        if n == 1000 and width not in (8, 16, 32):
            bits = "".join(f"{int(i):0{width}b}"[::-1] for i in ids)
            assert data == bytes(int(bits[k:k + 8][::-1], 2) for k in range(0, len(bits), 8))
            assert unpack_bits(data, width, 90, 901).tolist() == ids[901:991].tolist()


def test_bits_for():
    assert [bits_for(x) for x in (0, 1, 2, 255, 256, 49407)] == [1, 1, 2, 8, 9, 16]


def test_random_access_and_damage(tmp_path):
    rng, path = np.random.default_rng(1), str(tmp_path / "x.bits")
    texts = [rng.integers(0, 1 << 13, n, dtype=np.uint64).astype(np.uint32) for n in (0, 5, 3000, 1, 700)]
    w = FileWriter(path, 13, block_ids=64)
    for i, t in enumerate(texts):
        w.add(None if i == 3 else i, t)
    w.close()
    flat, f = np.concatenate(texts), FileReader(path)
    assert f.doc_ids == [0, 1, 2, None, 4] and f.lengths.tolist() == [0, 5, 3000, 1, 700] and f.n_ids == len(flat)
    for first, n in ((0, 0), (0, 1), (63, 2), (64, 64), (100, 3000), (0, len(flat)), (len(flat), 0)):
        assert f.ids(first, n).tolist() == flat[first:first + n].tolist()
    with pytest.raises(IndexError):
        f.ids(len(flat), 1)
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    bad = str(tmp_path / "bad.bits")
    open(bad, "wb").write(data)
    with pytest.raises(ValueError, match="damaged block"):
        FileReader(bad).ids(0, len(flat))
    open(bad, "wb").write(bytes(data[:-9]))
    with pytest.raises(ValueError):
        FileReader(bad)


def expected(spark, rows, path=PATH, end=2):
    tok = Tokenizer.from_file(path)
    hashes = spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "k long, t string").selectExpr("k", "xxhash64(t) AS h")
    hashes = {r.k: r.h for r in hashes.collect()}
    start, out = 0, []
    for k, (i, t) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, hashes[r[0]])):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


@pytest.mark.parametrize("file_ids", [1 << 25, 100])
def test_awkward_rows(spark, file_ids):
    path = new_folder(spark, "test")
    listed = write_token_files(docs(spark, AWKWARD + [(12, t) for t in ODD]), path, PATH, block_ids=32, file_ids=file_ids)
    want = expected(spark, AWKWARD + [(12, t) for t in ODD])
    got = sorted(read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in got] == want
    flat = [x for w in want for x in w[4]]
    assert listed.agg({"n_ids": "sum"}).first()[0] == len(flat) and {r.width for r in listed.collect()} == {16}
    if file_ids == 100:
        assert listed.count() > 3
    for first, n in ((0, 1), (95, 300), (len(flat) - 3, 3), (0, len(flat))):
        assert read_ids(spark, path, first, n).tolist() == flat[first:first + n]


def test_other_vocabulary_and_hot_id(spark):
    path = new_folder(spark, "test")
    rows = [(7, f"x{i % 9}") for i in range(300)] + [(i, "y z") for i in range(20)]
    write_token_files(docs(spark, rows), path, BYTES, end_id=50256, file_ids=40)
    got = sorted(read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == [r[:4] for r in expected(spark, rows, BYTES, 50256)]


def test_empty(spark):
    path = new_folder(spark, "test")
    assert write_token_files(docs(spark, []), path, PATH).count() == 0
    assert read_documents(spark, path).count() == 0


def test_query(spark):
    from netflow_spark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(QUERIES["op11_token_files"](spark, sf).collect())
    assert [tuple(r) for r in got] == [r[:4] for r in expected(spark, rows)]
