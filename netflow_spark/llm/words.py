"""Words and word hashes of whole Arrow batches, without a Python loop over words.

Words are the runs of bytes other than ``0x20 0x09-0x0D``; in UTF-8 these are the runs of such
characters. A word's hash is a polynomial over random byte values modulo 2**64, taken from running
sums, then mixed. Null text is empty text.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_IN_WORD = np.ones(256, dtype=np.int8)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = 0
CHUNK_BYTES = 1 << 20
_POWERS: dict = {}


def release() -> None:
    """Gives memory that a task no longer needs back to the system: its worker process lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run):
    """``run`` of ``mapInArrow``, after which a task's memory goes back to the system. Only once the generator has
    ended are its last batches and arrays free; what an idle worker keeps counts beside the next stage's tasks."""
    def tidy(batches):
        yield from run(batches)
        release()
    return tidy


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES, rows: int = 512):
    """Slices ``(first, text array with a line end after each text)`` of about ``limit`` bytes; one long text is one slice."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    size = pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    total = np.concatenate([[0], np.cumsum(size)])
    first = 0
    while first < len(col):
        last = max(first + 1, int(np.searchsorted(total, total[first] + limit, side="right")) - 1)
        last = min(last, first + rows, len(col))
        part = col.slice(first, last - first)
        yield first, pc.binary_join_element_wise(part, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        first = last


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets."""
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def words_of(texts: pa.Array, lower: bool):
    """``(bytes, offsets, word starts, word ends, text of each word, word hashes)`` of a slice of ``text_chunks``."""
    data, off = raw(texts)
    step = np.diff(_IN_WORD[data], prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    up, down = _powers(len(data) + 1)
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:len(data)], out=run[1:])
    h = mix((run[ends] - run[starts]) * down[starts])
    return data, off, starts, ends, np.searchsorted(off, starts, side="right") - 1, h
