"""SentencePiece encoding and decoding as weighted finite-state transduction.

The model file's parts become one transducer:

* the normaliser: identity here, a dummy space in front, every space to the space mark;
* the pieces: an arc for each piece, found through a trie;
* byte fallback: a character that is no piece is an arc that puts out its UTF-8 bytes' pieces.

States are (place, last symbol put out). Two symbols may follow each other only if merging the text
of both, alone, gives just these two again; any other pair has infinite weight, and every symbol
weighs one. Byte-pair merging is decided locally in this sense, so the one path of finite weight is
the segmentation that the model's merges give, and that path is the tropical shortest path.

Pieces hold space marks only at their start, so a text's ids are those of its words in a row, each
with the spaces before it; a task composes the transducer with each distinct word once.

Decoding puts the pieces' texts together and takes the dummy space off: the round trip is exact, but
for texts that hold the space mark itself, which comes back as a space. Null and empty texts have no
ids. Null ids and repeated rows are encoded like any other; empty tables give empty results. Only
the id and the text are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .words import _BYTE, _powers, mix, raw, release, text_chunks

_SPACE = "▁"
_CACHE_WORDS = 400_000


class Transducer:
    """Compiled from a model file of kind BPE."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with the identity normaliser and a dummy prefix are compiled")
        kinds = model.SentencePiece
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.follows: dict[str, dict[str, bool]] = {}
        texts = [b""] * len(model.pieces)
        for p, i in self.ids.items():
            texts[i] = p.replace(_SPACE, " ").encode()
        for b, i in self.bytes.items():
            texts[i] = bytes([b])
        self.text_size = np.array([len(t) for t in texts], dtype=np.int64)
        self.text_base = np.cumsum(self.text_size) - self.text_size
        self.text_flat = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def merged(self, text: str) -> list[str]:
        """Symbols of a short text by merging: always the pair of highest score, the first of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _arcs(self, word: str, i: int, last: str):
        """Symbols that may be put out next, longest first; all others have infinite weight."""
        found, n = [], len(word)
        for j in range(i + 1, n + 1):
            symbol = word[i:j]
            if symbol not in self.starts:
                if j == i + 1:
                    found.append(symbol)
                break
            if symbol in self.ids or j == i + 1:
                found.append(symbol)
        if not last:
            yield from reversed(found)
            return
        known = self.follows.setdefault(last, {})
        for symbol in reversed(found):
            ok = known.get(symbol)
            if ok is None:
                ok = known[symbol] = self.merged(last + symbol) == [last, symbol]
            if ok:
                yield symbol

    def shortest_path(self, word: str) -> list[str]:
        """Symbols on the path of finite weight from the start of ``word`` to its end.

        At most one path has a finite weight, so the search goes depth first and visits no state twice.
        """
        out: list[str] = []
        at, dead, arcs = 0, set(), [self._arcs(word, 0, "")]
        while at < len(word):
            for symbol in arcs[-1]:
                if (at + len(symbol), symbol) not in dead:
                    out.append(symbol)
                    at += len(symbol)
                    arcs.append(self._arcs(word, at, symbol))
                    break
            else:
                if not out:
                    return self.merged(word)
                arcs.pop()
                dead.add((at, out[-1]))
                at -= len(out.pop())
        return out

    def word_ids(self, word: str) -> list[int]:
        out: list[int] = []
        for s in self.shortest_path(word):
            i = self.ids.get(s)
            if i is None:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(i)
        return out


class Encoder:
    """Ids of the texts of Arrow arrays; remembers words while it lasts."""

    def __init__(self, path: str):
        self.machine = Transducer(path)
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.base = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def encode(self, texts: pa.Array):
        """``(ids, offsets)`` of texts that each end with a line end that isn't theirs (``text_chunks``)."""
        own = pc.utf8_slice_codeunits(texts, 0, -1) if len(texts) else texts
        own = pc.replace_substring(own, _SPACE, " ")
        lead = pc.if_else(pc.equal(pc.binary_length(own), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        data, off = raw(pc.binary_join_element_wise(lead, own, pa.scalar("", pa.large_string())))
        n_texts = len(texts)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(n_texts + 1, dtype=np.int64)
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[off[:-1][off[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        up, down = _powers(len(data) + 1)
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:len(data)], out=run[1:])
        h = mix((run[ends] - run[starts]) * down[starts])
        doc = np.searchsorted(off, starts, side="right") - 1
        if len(self.slots) > _CACHE_WORDS:
            self._clear()
        uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
        keys = uniq.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.slots]
        if new:
            blob, where = data.tobytes(), at[new]
            ids = [self.machine.word_ids(blob[a:b].decode().replace(" ", _SPACE)) for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            size = np.array([len(x) for x in ids], dtype=np.int64)
            self.slots.update(zip([keys[i] for i in new], range(len(self.size), len(self.size) + len(new))))
            self.base = np.concatenate([self.base, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], dtype=np.uint32)])
        slots = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))[inv]
        n = self.size[slots]
        last = np.cumsum(n)
        ids = self.flat[np.repeat(self.base[slots] - (last - n), n) + np.arange(last[-1])]
        per_text = np.bincount(doc, weights=n, minlength=n_texts).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


def decode(machine: Transducer, ids: np.ndarray) -> bytes:
    """UTF-8 text of one text's ids."""
    n = machine.text_size[ids]
    if not len(n):
        return b""
    last = np.cumsum(n)
    return machine.text_flat[np.repeat(machine.text_base[ids] - (last - n), n) + np.arange(last[-1])].tobytes()[1:]


def _run(path: str, keep: bool):
    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                ids, off = enc.encode(texts)
                rows = [ids[off[i]:off[i + 1]] for i in range(len(texts))]
                back = [decode(enc.machine, r) for r in rows]
                blobs = [r.astype("<u4").tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([len(r) for r in rows], pa.int64()),
                     pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                     pa.array(blobs if keep else [None] * len(rows), pa.binary()),
                     pa.array([b.decode("utf-8", "replace") for b in back] if keep else [None] * len(rows), pa.string())],
                    names=["_id", "n_ids", "ids_crc32", "decoded_sha256", "ids", "decoded"])
        del enc
        release()
    return run


def encode_and_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Per row of ``docs``: id, ``n_ids``, ``ids_crc32``, ``decoded_sha256`` of the text that the ids give back, and on
    request ``ids`` (little-endian uint32) and ``decoded``. Nothing is shuffled."""
    kind = docs.schema[id_col].dataType
    rows = id_and_text(docs, id_col, text_col).select(F.col("_id").cast("long"), "_text")
    out = rows.mapInArrow(_run(model, keep), "_id long, n_ids long, ids_crc32 long, decoded_sha256 string, ids binary, decoded string")
    return out.select(F.col("_id").cast(kind).alias(id_col), "n_ids", "ids_crc32", "decoded_sha256", *(["ids", "decoded"] if keep else []))
