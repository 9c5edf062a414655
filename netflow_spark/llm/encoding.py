"""Token ids of whole Arrow batches by the ``tokenizers`` library, each distinct piece of text encoded once.

A vocabulary file whose settings split at white space and then at changes between letters, digits and
other characters (``_SPLITS``, read from the file) gives a text the ids of its pieces in a row. Pieces of
words of ASCII and of letters from U+00C0 to U+00FF are cut and lower-cased in numpy, made distinct by Arrow
(by their bytes, not by a hash), and each new one goes through the file's model. Words with other characters,
apostrophes or ``<`` are looked up as they stand and encoded one by one. A file with other settings is accepted
too: its texts then go through the library whole.

Null text is empty text and has no ids. Very long texts are cut into slices at white space by the caller's
chunks; a text is never held twice.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import raw

_CACHE_PIECES = 600_000

# The settings of a vocabulary file that this module cuts by itself.
_SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}
_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False}
_LATIN = re.compile("[\x21-\x7eÀ-įı-ɏ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}

# Classes of bytes: white space, letters, digits, other printable ASCII; ODD words are not cut.
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, dtype=np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[ord("'"), ord("<")]] = _ODD
_LATIN_LEAD, _TIMES, _DIVIDE, _SHARP_S = 0xC3, 0x97, 0xB7, 0x9F  # U+00C0 to U+00FF in UTF-8: the first byte, and second bytes
_CLASS[_LATIN_LEAD] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def splits_known(path: str) -> bool:
    """Does the vocabulary file split texts as this module does?"""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    special = [t["content"] for t in got["added_tokens"]]
    return (all(got.get(k) == v for k, v in _SPLITS.items()) and all(got["model"].get(k) == v for k, v in _MODEL.items())
            and all(t.startswith("<") and not re.search(r"\s", t) for t in special)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in got["added_tokens"]))


class TextEncoder:
    """``encode`` gives the ids of a slice of texts (``words.text_chunks``); equal to the library's for every text."""

    def __init__(self, path: str, cache: int = _CACHE_PIECES):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.known = splits_known(path)
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.base = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)

    def _part_ids(self, part: str) -> list[int]:
        return [t.id for t in self.tok.model.tokenize(part if part.isascii() else "".join([_BYTE_CHARS[b] for b in part.encode()]))]

    def _odd_ids(self, word: str) -> list[int]:
        if "<|" in word or not _LATIN.fullmatch(word):
            return self.tok.encode(word, add_special_tokens=False).ids
        out: list[int] = []
        for part in _PARTS.findall(word.lower()):
            ids = self.parts.get(part)
            if ids is None:
                ids = self.parts[part] = self._part_ids(part)
            out += ids
        return out

    def _slots_of(self, pieces: list[str], odd: np.ndarray) -> np.ndarray:
        if len(self.slots) + len(self.parts) > self.cache:
            self._clear()
        slots, new, first = self.slots, [], len(self.size)
        out = np.empty(len(pieces), dtype=np.int64)
        for i, p in enumerate(pieces):
            at = slots.get(p)
            if at is None:
                at = slots[p] = first + len(new)
                new.append(self._odd_ids(p) if odd[i] else self._part_ids(p))
            out[i] = at
        if new:
            size = np.fromiter(map(len, new), np.int64, len(new))
            self.base = np.concatenate([self.base, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(new), np.uint32, int(size.sum()))])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32) and the offset of each text's first id."""
        if not self.known:
            ids = [e.ids for e in self.tok.encode_batch([t[:-1] for t in texts.to_pylist()], add_special_tokens=False)]
            off = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(off[-1])), off
        data, off = raw(texts)
        kind, low = _CLASS[data], _LOWER[data]
        at = np.int32 if len(data) < 1 << 31 else np.int64
        second = np.flatnonzero(data == _LATIN_LEAD) + 1
        byte = data[second]
        kind[second[(byte != _TIMES) & (byte != _DIVIDE)]] = _LETTER
        low[second[(byte < _SHARP_S) & (byte != _TIMES)]] += 32
        del second, byte
        inside = kind != _SPACE
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        del edge
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        odd = np.maximum.reduceat(kind, starts) == _ODD
        for a, b in zip(starts[odd].tolist(), ends[odd].tolist()):
            kind[a:b] = _ODD
        del starts, ends, odd
        cut = np.empty(len(kind), dtype=bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == _DIGIT
        cut &= inside
        first = np.flatnonzero(cut).astype(at)
        del cut
        kept = np.where(kind == _ODD, data, low)[inside]
        odd = kind[first] == _ODD
        del kind, low
        bounds = np.empty(len(first) + 1, dtype=np.int64)
        bounds[:-1] = np.cumsum(inside, dtype=at)[first]
        bounds[:-1] -= 1
        bounds[-1] = len(kept)
        del inside
        pieces = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(kept)).dictionary_encode()
        del bounds, kept
        code = pieces.indices.to_numpy()
        is_odd = np.zeros(len(pieces.dictionary), dtype=bool)
        is_odd[code] = odd
        slots = self._slots_of(pieces.dictionary.to_pylist(), is_odd)
        del pieces, odd, is_odd
        n = self.size[slots][code]
        done = np.concatenate([[0], np.cumsum(n)])  # ids before each piece
        per_text = np.diff(done[np.searchsorted(first, off.astype(at))])
        del first
        source = np.repeat(self.base[slots][code] - done[:-1], n)
        source += np.arange(done[-1])
        return self.flat[source], np.concatenate([[0], np.cumsum(per_text)])
