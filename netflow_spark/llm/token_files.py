"""Token-id files: fixed-width bit packing with block offsets.

Every id takes ``width`` bits, the fewest that hold any id of the vocabulary. A file is

    header   magic, width, ids per block
    blocks   ids back to back, lowest bit first; each block starts at a byte of its own
    footer   byte offset of every block (and of the end), CRC-32 of every block,
             id, first token and length of every document
    tail     counts, CRC-32 and size of the footer, magic

so that any range of ids is read with two ranged reads (tail and footer, then the blocks that hold it)
and unpacked by numpy without a loop over ids.

``write_token_files`` sorts the documents by id over all tasks and lets each task encode its range and write
its files; files are named by attempt and count only when the manifest (one row per
file, written by Spark) lists them, so a lost or repeated task leaves nothing half done. A file holds
``file_ids`` ids or one longer document. ``read_documents`` reads the files back, one task per file.

Documents ascend by id, null ids first; rows that repeat an id follow the 64-bit hash of their text, so only
equal rows may change places. Null text is empty text: its only token is the end id. An
empty table gives an empty manifest and no files. Only the id and the text are read.
"""

from __future__ import annotations

import struct
import zlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, written
from .encoding import TextEncoder
from .words import release, text_chunks

END_ID, BLOCK_IDS, FILE_IDS = 2, 1 << 16, 1 << 25
_MAGIC, _HEADER, _TAIL = b"BITIDS01", "<8sII", "<QQQIQ8s"
_CHUNK_BYTES, _READ_IDS = 4 << 20, 1 << 20


def bits_for(largest: int) -> int:
    """The fewest bits that hold every id from 0 to ``largest``."""
    return max(1, int(largest).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` (each below ``2**width``, ``width`` at most 32) at ``width`` bits, lowest bit first, filled up to a byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    n = len(ids)
    rows = np.zeros(((n + 7) // 8, 8), dtype=np.uint64)
    rows.ravel()[:n] = ids
    out = np.zeros((len(rows), width), dtype=np.uint8)  # eight ids take ``width`` bytes
    for lane in range(8):
        first, shift = divmod(lane * width, 8)
        value = rows[:, lane] << np.uint64(shift)
        for k in range((shift + width + 7) // 8):
            out[:, first + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[:(n * width + 7) // 8]


def unpack_bits(data, width: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` ids (uint32) after the first ``skip`` ones of packed bytes."""
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n, offset=skip * width // 8).astype(np.uint32)
    if not n:
        return np.zeros(0, dtype=np.uint32)
    buf = bytes(data) + bytes(8)
    windows = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))  # eight bytes from every byte on
    bit = np.arange(skip, skip + n, dtype=np.int64) * width
    return ((windows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def _store(path: str):
    """File system and path of a Hadoop path (``file:/x``, ``hdfs://h/x``, ``s3://b/x``, ``/x``)."""
    from pyarrow import fs
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


class FileWriter:
    """One file, written from front to back; ids of a document may come in parts."""

    def __init__(self, path: str, width: int, block_ids: int = BLOCK_IDS):
        where, name = _store(path)
        self.width, self.block_ids = width, block_ids
        self.out = where.open_output_stream(name)
        self.out.write(struct.pack(_HEADER, _MAGIC, width, block_ids))
        self.at, self.offsets, self.sums = struct.calcsize(_HEADER), [], []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 16 * self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, dtype=np.uint32), *self.waiting])
        whole = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for i in range(0, whole, self.block_ids):
            block = pack_bits(ids[i:min(i + self.block_ids, whole)], self.width)
            self.offsets.append(self.at)
            self.sums.append(zlib.crc32(block))
            self.out.write(block)
            self.at += len(block)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        known = np.array([d is not None for d, _, _ in self.docs], dtype=np.uint8)
        footer = b"".join([
            np.array([*self.offsets, self.at], dtype="<u8").tobytes(), np.array(self.sums, dtype="<u4").tobytes(), known.tobytes(),
            np.array([d or 0 for d, _, _ in self.docs], dtype="<i8").tobytes(),
            *(np.array([d[k] for d in self.docs], dtype="<u8").tobytes() for k in (1, 2))])
        self.out.write(footer)
        self.out.write(struct.pack(_TAIL, self.n_ids, len(self.docs), len(self.offsets), zlib.crc32(footer), len(footer), _MAGIC))
        self.out.close()


class FileReader:
    """Random access to one file: ``ids(first, n)`` and the documents ``doc_ids``, ``starts``, ``lengths``."""

    def __init__(self, path: str):
        where, name = _store(path)
        self.path, self.file = path, where.open_input_file(name)
        size, head, tail = self.file.size(), struct.calcsize(_HEADER), struct.calcsize(_TAIL)
        if size < head + tail:
            raise ValueError(f"{path}: not a token-id file")
        magic, self.width, self.block_ids = struct.unpack(_HEADER, self.file.read_at(head, 0))
        self.n_ids, n_docs, n_blocks, check, long, end = struct.unpack(_TAIL, self.file.read_at(tail, size - tail))
        if magic != _MAGIC or end != _MAGIC:
            raise ValueError(f"{path}: not a token-id file")
        footer = self.file.read_at(long, size - tail - long)
        if zlib.crc32(footer) != check:
            raise ValueError(f"{path}: damaged footer")
        parts, at = [], 0
        for dtype, n in (("<u8", n_blocks + 1), ("<u4", n_blocks), ("u1", n_docs), ("<i8", n_docs), ("<u8", n_docs), ("<u8", n_docs)):
            parts.append(np.frombuffer(footer, dtype=dtype, count=n, offset=at))
            at += parts[-1].nbytes
        self.offsets, self.sums, known, ids, self.starts, self.lengths = parts
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]

    def ids(self, first: int, n: int) -> np.ndarray:
        """Ids ``first`` to ``first + n`` of the file; reads the blocks that hold them and no others."""
        if first < 0 or n < 0 or first + n > self.n_ids:
            raise IndexError(f"{self.path}: ids {first} to {first + n} of {self.n_ids}")
        if not n:
            return np.zeros(0, dtype=np.uint32)
        a, b = first // self.block_ids, (first + n - 1) // self.block_ids
        start = int(self.offsets[a])
        data = memoryview(self.file.read_at(int(self.offsets[b + 1]) - start, start))
        out = []
        for k in range(a, b + 1):
            block = data[int(self.offsets[k]) - start:int(self.offsets[k + 1]) - start]
            if zlib.crc32(block) != self.sums[k]:
                raise ValueError(f"{self.path}: damaged block {k}")
            skip = max(0, first - k * self.block_ids)
            out.append(unpack_bits(block, self.width, min(first + n - k * self.block_ids, self.block_ids) - skip, skip))
        return np.concatenate(out)

    def close(self) -> None:
        self.file.close()


def _write_files(path: str, tokenizer: str, end_id: int, width: int, block_ids: int, file_ids: int):
    def run(batches):
        enc, end = TextEncoder(tokenizer), np.array([end_id], dtype=np.uint32)
        task, seq, out, rows = TaskContext.get().partitionId(), 0, None, []

        def close():
            out.close()
            rows.append((name, task, seq, out.n_ids, len(out.docs)))

        for batch in batches:
            for first, texts in text_chunks(batch.column(1), _CHUNK_BYTES, 8192):
                ids, off = enc.encode(texts)
                who = batch.column(0).slice(first, len(texts)).to_pylist()
                for doc_id, a, b in zip(who, off[:-1].tolist(), off[1:].tolist()):
                    if out is not None and out.n_ids + b - a + 1 > file_ids:
                        close()
                        seq, out = seq + 1, None
                    if out is None:
                        name = f"{path}/{task:06d}-{seq:05d}-{uuid4().hex}.bits"
                        out = FileWriter(name, width, block_ids)
                    out.add(doc_id, np.concatenate([ids[a:b], end]))
        if out is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "_task", "_seq", "n_ids", "n_docs"])
        del enc
        release()
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the files and the manifest into the folder ``path`` (shared, new) and returns the manifest.

    Manifest: ``file``, ``start`` (ids in all files before it), ``n_ids``, ``n_docs``, ``width``.
    """
    from tokenizers import Tokenizer
    width = bits_for(max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id))
    # the hash and the place in the input part rows that repeat an id, however many
    rows = id_and_text(docs, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), "_text", F.xxhash64("_text").alias("_hash"),
                                                      F.monotonically_increasing_id().alias("_at"))
    order = ["_id", "_hash", "_at"]
    where, name = _store(f"{path}/files")
    where.create_dir(name, recursive=True)
    files = (rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_id", "_text")
             .mapInArrow(_write_files(f"{path}/files", tokenizer, end_id, width, block_ids, file_ids),
                         "file string, _task long, _seq long, n_ids long, n_docs long"))
    files = written(files, "files")
    before = Window.orderBy("_task", "_seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    listed = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids", "n_docs", F.lit(width).alias("width"))
    listed.write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(listed.schema).parquet(f"{path}/manifest")


def _read_files(with_ids: bool):
    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = FileReader(name)
                starts, ends = f.starts.astype(np.int64), (f.starts + f.lengths).astype(np.int64)
                k = 0
                while k < len(starts):
                    last = max(k + 1, int(np.searchsorted(ends, starts[k] + _READ_IDS, side="right")))
                    first, stop = int(starts[k]), int(ends[last - 1])
                    crcs, kept = [], []
                    if last == k + 1 and not with_ids:  # a long document passes in parts
                        crc = 0
                        for a in range(first, stop, _READ_IDS):
                            crc = zlib.crc32(f.ids(a, min(_READ_IDS, stop - a)).astype("<u4"), crc)
                        crcs.append(crc)
                    else:
                        ids = f.ids(first, stop - first).astype("<u4")
                        for a, b in zip((starts[k:last] - first).tolist(), (ends[k:last] - first).tolist()):
                            crcs.append(zlib.crc32(ids[a:b]))
                            if with_ids:
                                kept.append(ids[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[k:last], pa.int64()), pa.array(starts[k:last] + start, pa.int64()),
                         pa.array(f.lengths[k:last].astype(np.int64)), pa.array(crcs, pa.int64()),
                         pa.array(kept, pa.list_(pa.int64())) if with_ids else pa.nulls(last - k, pa.list_(pa.int64()))],
                        names=["_id", "start", "n_tokens", "ids_crc32", "ids"])
                    k = last
                f.close()
        release()
    return run


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """From the files: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` (and ``ids``)."""
    files = spark.read.parquet(f"{path}/manifest").select("file", "start")
    n = max(1, files.count())
    found = files.repartition(n).mapInArrow(_read_files(with_ids), "_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")
    return found.select(F.col("_id").alias(id_col), "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_ids(spark: SparkSession, path: str, first: int, n: int) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of the whole store, from the blocks that hold them."""
    files = spark.read.parquet(f"{path}/manifest").where((F.col("start") < first + n) & (F.col("start") + F.col("n_ids") > first))
    out = []
    for row in files.orderBy("start").collect():
        f = FileReader(row["file"])
        a, b = max(first - row["start"], 0), min(first + n - row["start"], row["n_ids"])
        out.append(f.ids(a, b - a))
        f.close()
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
