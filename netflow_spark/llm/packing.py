"""Best-fit packing with Martello-Toth dominance reduction.

Documents are tokenized, an end id is added, and only documents longer than a sequence are cut.
Piece lengths are whole numbers from 1 to ``capacity``, so the instance is fully described by how
many pieces have each length: a histogram of at most ``capacity`` rows, whatever the corpus. On it

1. the reduction fixes small sets that dominate every other choice for the longest piece left
   (alone if nothing fits beside it; with the piece that fills the sequence exactly; with the
   largest piece that fits if no two others fit, or if it is at least as long as any two that fit),
   for all pieces of that length at once, and repeats on what is left;
2. best-fit (longest first, into the fullest sequence that still has room) packs the rest, again
   for whole runs of equal sequences at once.

The plan says for the k-th piece of a length where it goes. Pieces learn their k from counts per
(task, length), so no task sees all pieces of a length, and the plan (a few rows per length) is
broadcast.

Null text is empty text: its one piece holds the end id alone. Null ids and repeated rows are packed
like any other row. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, id_and_text, written
from .encoding import TextEncoder
from .words import released, text_chunks

CAPACITY, END_ID = 4096, 1
_CHUNK_BYTES, _BATCH_ROWS = 1 << 20, 1000


def _piece_maker(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches):
        enc = TextEncoder(path)
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for first, texts in text_chunks(batch.column(1), _CHUNK_BYTES, 8192):
                ids, off = enc.encode(texts)
                who = batch.column(0).slice(first, len(texts)).to_pylist()
                rows = []
                for i, doc_id in enumerate(who):
                    own = np.append(ids[off[i]:off[i + 1]], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity].tobytes()
                        n = len(part) // 4
                        rows.append((doc_id, piece, start, n, zlib.crc32(part), task, seen[n], part if keep_ids else None))
                        seen[n] += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["_id", "piece", "start", "length", "ids_crc32", "_task", "_nth", "ids"])
                del texts, ids, off, own, part, rows, cols
            del batch  # before the next one is read
    return released(run)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids, numbered per task and length. ``ids`` (little-endian uint32) on request."""
    rows = id_and_text(docs, id_col, text_col).select(F.col("_id").cast("long"), "_text")
    return rows.mapInArrow(_piece_maker(tokenizer, capacity, end_id, keep_ids),
                           "_id long, piece int, start long, length long, ids_crc32 long, _task int, _nth long, ids binary")


def reduce_dominated(count: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed sets ``(lengths, how many sequences)`` and the instance that is left."""
    left = {n: c for n, c in count.items() if c > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    skipped: dict[int, int] = {}

    def take(lengths: tuple[int, ...], k: int) -> None:
        fixed.append((lengths, k))
        for n in lengths:
            left[n] -= k
            if not left[n]:
                del left[n]

    while left:
        big = max(left)
        room = capacity - big
        others = {**left, **skipped, big: left[big] - 1}
        fits = np.array(sorted(n for n, c in others.items() if c and n <= room), dtype=np.int64)
        if not len(fits):
            take((big,), left[big])
            continue
        best = int(fits[-1])
        # a set fixed for one piece of this length is as good for the next one: what else fits only gets less
        if best in left and (best == room or _dominates(fits, np.array([others[n] for n in fits.tolist()]), best, room)):
            if best != big:
                take((big, best), min(left[big], left[best]))
            else:
                take((big, big), left[big] // 2)
            continue
        skipped[big] = left.pop(big)
    return fixed, skipped


def _dominates(fits: np.ndarray, counts: np.ndarray, best: int, room: int) -> bool:
    """Does ``best`` beside the longest piece dominate all sets of other pieces that fit there? Then no three
    fit, and any two that do are no longer than ``best`` together."""
    smallest = np.repeat(fits[:3], np.minimum(counts[:3], 3))[:3]
    if len(smallest) == 3 and smallest.sum() <= room:
        return False
    at = np.searchsorted(fits, room - fits, side="right") - 1
    at = np.where((at >= 0) & (at == np.arange(len(fits))) & (counts < 2), at - 1, at)
    ok = at >= 0
    return not ok.any() or int((fits + fits[at])[ok].max()) <= best


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: ``(((length, times), ...), how many sequences)``."""
    open_: dict[int, list] = defaultdict(list)  # room left -> [contents, sequences]
    done: list = []
    for n in sorted(count, reverse=True):
        todo = count[n]
        for room in sorted(r for r in open_ if r >= n):
            if not todo:
                break
            per = room // n
            groups, open_[room] = open_[room], []
            for contents, k in groups:
                full = min(k, todo // per)
                if full:
                    open_[room - per * n].append((contents + ((n, per),), full))
                    todo -= full * per
                part = 0
                if todo and full < k:
                    open_[room - todo * n].append((contents + ((n, todo),), 1))
                    todo, part = 0, 1
                if k - full - part:
                    open_[room].append((contents, k - full - part))
            if not open_[room]:
                del open_[room]
        if todo:
            per = capacity // n
            if todo // per:
                open_[capacity - per * n].append((((n, per),), todo // per))
            if todo % per:
                open_[capacity - todo % per * n].append((((n, todo % per),), 1))
        done += open_.pop(0, [])
    return done + [g for groups in open_.values() for g in groups]


def plan_slots(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first, last, sequence, per sequence, offset)``: the pieces ``first <= k < last`` of a
    length fill sequences from ``sequence`` on, ``per`` to each, from ``offset`` on."""
    fixed, rest = reduce_dominated(count, capacity)
    groups = []
    for lengths, k in fixed:
        groups.append((tuple((n, lengths.count(n)) for n in dict.fromkeys(lengths)), k))
    groups += best_fit(rest, capacity)
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for contents, k in groups:
        offset = 0
        for n, per in contents:
            out.append((n, used[n], used[n] + per * k, sequence, per, offset))
            used[n] += per * k
            offset += per * n
        sequence += k
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``)."""
    with arrow_batches(docs.sparkSession, _BATCH_ROWS):
        rows = written(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids), "pieces")
    counts = rows.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "starts")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = docs.sparkSession.createDataFrame(plan_slots(histogram, capacity) or [(0, 0, 0, 0, 1, 0)],
                                              "length long, _first long, _last long, _sequence long, _per long, _offset long")
    # ranges of a task's pieces meet ranges of the plan: the number of both is bounded by tasks and lengths
    numbered = (rows.join(starts.select("length", "_task", "_before"), ["length", "_task"])
                .withColumn("_k", F.col("_before") + F.col("_nth")))
    placed = numbered.join(F.broadcast(slots), "length").where("_k >= _first and _k < _last")
    return placed.select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32",
                         F.expr("_sequence + (_k - _first) div _per").alias("sequence_id"),
                         F.expr("_offset + (_k - _first) % _per * length").alias("offset"), *(["ids"] if keep_ids else []))
