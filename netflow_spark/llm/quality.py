"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network
and temperature-calibrated probabilities.

1. Every word (case folded) falls into one of ``BUCKETS`` buckets; a bucket has a fixed sparse
   random index vector. One pass over all documents adds up, for each bucket, the index vectors of
   the words beside it: its context vector. Tasks add up locally, one row per bucket is shuffled.
2. A document is the mean context vector of its words, joined by the mean index vector of its
   words' shapes (letter case, digits, punctuation, symbols, length, whether the word repeats the
   one before). Empty texts are the zero vector.
3. Labelled documents outside the held-out fifth (crc32 of the id's text, modulo 5, is 0) train a
   two-layer network on the driver: a bounded sample of ``max_train`` rows of fixed width. A part
   of it sets the temperature.

Null labels are ignored, of contradictory ones the largest counts. Without any label every score is
0.5. Null ids are scored and count as not held out. Only the id and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .words import released, text_chunks, words_of

BUCKETS, DIM, NONZERO = 1 << 13, 64, 4
SHAPES, SHAPE_DIM = 64 * 5 * 2, 32
WIDTH = DIM + SHAPE_DIM
THRESHOLD = 0.3

_RNG = np.random.Generator(np.random.PCG64(7))
_PLACE = _RNG.integers(0, DIM, (BUCKETS, NONZERO))
_SIGN = _RNG.choice([-1.0, 1.0], (BUCKETS, NONZERO))
_SHAPE_INDEX = _RNG.choice([-1.0, 0.0, 1.0], (SHAPES, SHAPE_DIM), p=[0.15, 0.7, 0.15]).astype(np.float32)
_CLASS = np.full(256, 32, dtype=np.uint8)  # symbols
_CLASS[:0x21] = 0
_CLASS[0x80:] = 0
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 2
_CLASS[[ord(c) for c in "0123456789"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 8
_CLASS[[ord(c) for c in "!?"]] = 16


@dataclass
class Model:
    """Fixed-size parameters: context vectors of the buckets and the network."""
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0.0) @ self.w2 + self.b2
        return 1.0 / (1.0 + np.exp(-np.clip(z / self.temperature, -40, 40)))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def _contexts(batches):
    total = np.zeros(BUCKETS * DIM)
    for batch in batches:
        left, right = [], []
        for _, texts in text_chunks(batch.column(0)):
            *_, doc, h = words_of(texts, lower=True)
            b = (h >> np.uint64(64 - 13)).astype(np.int64)
            same = doc[1:] == doc[:-1]
            left.append(b[:-1][same])
            right.append(b[1:][same])
            if sum(map(len, left)) > 1 << 20:
                total += _pairs(left, right)
                left, right = [], []
        if left:
            total += _pairs(left, right)
    rows = total.reshape(BUCKETS, DIM)
    used = np.flatnonzero(np.abs(rows).any(axis=1))
    flat = pa.array(rows[used].astype(np.float32).ravel())
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.FixedSizeListArray.from_arrays(flat, DIM).cast(pa.list_(pa.float32()))], names=["bucket", "v"])


def _pairs(left: list, right: list) -> np.ndarray:
    a, b = np.concatenate(left), np.concatenate(right)
    out = np.zeros(BUCKETS * DIM)
    for here, beside in ((a, b), (b, a)):
        for k in range(NONZERO):
            out += np.bincount(here * DIM + _PLACE[beside, k], weights=_SIGN[beside, k], minlength=BUCKETS * DIM)
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all documents: ``BUCKETS x DIM``, whatever the input's size."""
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(released(_contexts), "bucket int, v array<float>")
    sums = parts.groupBy("bucket").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(DIM)]).alias("v"))
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for row in sums.collect():
        out[row["bucket"]] = row["v"]
    out -= out.mean(axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Feature rows of a text column."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    for first, part in text_chunks(texts, rows=256):
        data, _, starts, ends, doc, h = words_of(part, lower=True)
        if not len(starts):
            continue
        n = len(part)
        bucket = (h >> np.uint64(64 - 13)).astype(np.int64)
        length = np.searchsorted([3, 6, 10, 15], ends - starts, side="right")
        again = np.zeros(len(h), dtype=np.int64)
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        shape = (np.bitwise_or.reduceat(_CLASS[data], starts).astype(np.int64) * 5 + length) * 2 + again
        words = np.bincount(doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
        shapes = np.bincount(doc * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES).astype(np.float32)
        count = np.maximum(shapes.sum(axis=1, keepdims=True), 1)
        out[first:first + n, :DIM] = words @ vectors / count
        out[first:first + n, DIM:] = shapes @ _SHAPE_INDEX / count
    return out


def _featurizer(vectors: np.ndarray):
    def run(batches):
        for b in batches:
            f = pooled(b.column(1), vectors).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in f], pa.binary())], names=["id", "f"])
    return released(run)


def features(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        _featurizer(vectors), "id long, f binary")


def _unpack(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.float16).reshape(-1, WIDTH).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> Model:
    """Two-layer network by Adam, then one temperature from rows it has not seen."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(x))
    x, y = x[order], y[order].astype(np.float64)
    if len(x) == 0:
        return Model(vectors, np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    cut = len(z) - len(z) // 5
    p = [rng.normal(0, WIDTH ** -0.5, (WIDTH, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(cut), max(1, cut // 128)):
            a = z[at] @ p[0] + p[1]
            hid = np.maximum(a, 0)
            err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3][0], -40, 40))) - y[at]) / len(at)
            back = np.outer(err, p[2]) * (a > 0)
            grads = [z[at].T @ back + 1e-4 * p[0], back.sum(axis=0), hid.T @ err + 1e-4 * p[2], np.array([err.sum()])]
            t += 1
            for q, g, mi, vi in zip(p, grads, m, v):
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                q -= 0.003 * (mi / (1 - 0.9 ** t)) / (np.sqrt(vi / (1 - 0.99 ** t)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    rest, want = x[cut:], y[cut:]
    if len(rest):
        def loss(temp: float) -> float:
            model.temperature = temp
            s = np.clip(model.score(rest), 1e-9, 1 - 1e-9)
            return float(-(want * np.log(s) + (1 - want) * np.log(1 - s)).mean())
        model.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_train: int = 20_000) -> tuple[Model, DataFrame]:
    """The model, and the written feature rows of all documents. At most ``max_train`` labelled rows are fitted and reach
    the driver, chosen by the hash of their ids; of rows that repeat an id one is (with the smallest features)."""
    vectors = word_vectors(docs, text_col)
    feats = written(features(docs, vectors, id_col, text_col), "features")
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null")
             .groupBy("id").agg(F.max("y").alias("y")).where(~held_out(F.col("id"))))
    share = min(1.0, max_train / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    one_each = feats.join(some, "id").groupBy("id", "y").agg(F.min("f").alias("f"))
    rows = one_each.orderBy(F.xxhash64("id"), "id").limit(max_train).toPandas().sort_values("id")
    x = _unpack(rows["f"]) if len(rows) else np.zeros((0, WIDTH), dtype=np.float32)
    return fit(x, rows["y"].to_numpy(), vectors), feats


def _scorer(model: Model):
    def run(batches):
        for b in batches:
            s = model.score(_unpack(b.column(1).to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(np.float64))], names=["id", "score"])
    return released(run)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", threshold: float = THRESHOLD, max_train: int = 20_000) -> DataFrame:
    """Per row of ``docs``: id, ``held_out``, ``score`` (chance of label 1) and ``predicted``."""
    model, feats = train(docs, labels, id_col, text_col, label_col, max_train)
    model.vectors = None  # the features hold what it has to say
    scored = feats.mapInArrow(_scorer(model), "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", threshold: float = THRESHOLD, max_train: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; no row is shuffled."""
    model, _ = train(docs, labels, id_col, text_col, label_col, max_train)
    where = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            ok = model.score(pooled(b.column(where), model.vectors).astype(np.float16).astype(np.float32)) >= threshold
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(released(run), docs.schema)
