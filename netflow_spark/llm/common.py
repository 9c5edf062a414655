"""Helpers of the training-data operators: shared tables, Bloom words, connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .words import released

#: Bits of one half of the Bloom filter: at most 2 * 2**26 / 64 words of 16 bytes (32 MB) are broadcast.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared checkpoint folder; it goes when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts the lineage, survives lost executors.

    The folder goes when the driver's JVM ends.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """What is run inside gets its Arrow batches in at most so many rows: a Python worker holds two of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    least = min(rows, int(before)) if int(before) > 0 else rows
    spark.conf.set(key, str(least))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under its own names; null text is empty text."""
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) + seed * bits for seed in (0, 1)]


def bloom_words(keys: DataFrame, key: str, bits: int = FILTER_BITS, repeated: bool = False) -> DataFrame:
    """First pass of two: a Bloom filter of the ``key`` values, or of those that may occur more than once.

    Each key sets one bit in either half; for repeated keys, a bit set by one row only is left out.
    Returns 64-bit words ``(_word, _bits)``, at most ``2 * bits / 64`` rows.
    """
    pos = keys.select(F.explode(F.array(*_positions(F.col(key), bits))).alias("_pos"))
    if repeated:
        pos = pos.groupBy("_pos").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return (pos.groupBy(F.shiftright("_pos", 6).alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_pos & 63 as int))")).alias("_bits")))


def mark_members(df: DataFrame, key: Column, words: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """Second pass: adds ``flag``, true where ``key`` may be in the filter; never false where it is.

    The words have a proven size bound, so they are broadcast and no row moves.
    """
    out = df
    for i, pos in enumerate(_positions(key, bits)):
        side = F.broadcast(words.select(F.col("_word").alias(f"_w{i}"), F.col("_bits").alias(f"_b{i}")))
        out = out.withColumn(f"_p{i}", pos)
        out = out.join(side, F.shiftright(f"_p{i}", 6) == F.col(f"_w{i}"), "left")
    hit = [F.coalesce(F.expr(f"shiftright(_b{i}, cast(_p{i} & 63 as int)) & 1L"), F.lit(0)) == 1 for i in (0, 1)]
    return out.withColumn(flag, hit[0] & hit[1]).drop(*[f"_{c}{i}" for c in "pwb" for i in (0, 1)])


def _local_forest(batches):
    """Edges of one partition as stars: every node with the smallest node it reaches inside the partition."""
    import numpy as np
    import pyarrow as pa
    tables = list(batches)
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while len(x):
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        x, y = label[x], label[y]
        left = x != y
        x, y = x[left], y[left]
    roots = nodes[label]
    off = roots != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(roots[off])], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Distributed union-find: ``(node, component)`` for every node (long) of ``edges`` (columns ``a``, ``b``).

    Each partition first shrinks its own edges to stars. Then, in rounds, every node is hooked to its
    smallest neighbour, pointers are shortened until flat and the edges are rewritten between the
    roots; done when no edge joins two roots. All tables are written, so the joins read fresh
    exchanges and adaptive execution can split a hot root; only single rows reach the driver.
    ``component`` is the smallest node reachable. Self-links and repeated links are allowed.
    """
    down = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b")
    e = written(down.mapInArrow(released(_local_forest), "a long, b long"), "edges")
    nodes = edges.select(F.explode(F.array(F.col("a").cast("long"), F.col("b").cast("long"))).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    for _ in range(max_rounds):
        if is_empty(e):
            return labels
        # a > b on every edge: a node hooks to its smallest neighbour, if that is smaller
        parent = written(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "parents")
        moved = True
        while moved:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            one = parent.join(up, "parent", "left").select("node", "parent", F.coalesce("grand", "parent").alias("p2"))
            two = one.join(up.select(F.col("parent").alias("p2"), F.col("grand").alias("p3")), "p2", "left")
            parent = written(two.select("node", F.coalesce("p3", "p2").alias("parent"), (F.col("parent") != F.coalesce("p3", "p2")).alias("moved")), "jumped")
            moved = not is_empty(parent.where("moved"))
            parent = parent.select("node", "parent")
        to = parent.select(F.col("node").alias("component"), F.col("parent").alias("root"))
        labels = written(labels.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        pa, pb = (parent.select(F.col("node").alias(c), F.col("parent").alias(f"r{c}")) for c in "ab")
        between = (e.join(pa, "a", "left").join(pb, "b", "left")
                   .select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y"))
        e = written(between.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
                    .mapInArrow(released(_local_forest), "a long, b long"), "edges")
    raise RuntimeError("components did not converge")
