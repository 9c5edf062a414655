import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from cases import AWKWARD, docs

from netflow_spark.llm.sentencepieces import Encoder, decode, encode_and_decode
from netflow_spark.llm.words import text_chunks

PATH = public_tokenizers.path("piece_bpe_32k.model")


def own(texts):
    enc, ids, back = Encoder(PATH), [], []
    for _, part in text_chunks(pa.array(texts)):
        flat, off = enc.encode(part)
        for i in range(len(part)):
            ids.append(flat[off[i]:off[i + 1]].tolist())
            back.append(decode(enc.machine, flat[off[i]:off[i + 1]]).decode())
    return ids, back


def test_ids_and_round_trip(spark):
    rng = random.Random(1)
    bits = list("abcdehilnorst   ") + ["é", "ß", "字", "😀", "\n", "\t", "▁", " ", "  ", "1", "23", "the", "ing", "İ", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", " ", "   a ", "a▁b"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids, back = own(texts)
    assert ids == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)
    assert back == [t.replace("▁", " ") for t in texts]


def test_awkward_rows(spark):
    got = encode_and_decode(docs(spark, AWKWARD), PATH, keep=True).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted(((i, sp.encode(t or ""), (t or "").replace("▁", " ")) for i, t in AWKWARD), key=repr)
    assert sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.decoded) for r in got), key=repr) == want
    assert encode_and_decode(docs(spark, []), PATH).count() == 0
