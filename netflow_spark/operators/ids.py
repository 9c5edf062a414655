"""Flow identifiers.

``hash_id`` is the scalable default: a 64-bit xxhash of the key, no shuffle at all.
``dense_id`` reproduces the reference's ``flow_id`` (0-based rank of the sorted key) without an
unpartitioned window: a range-partitioned sort, ``monotonically_increasing_id`` inside each
partition, and one offset per partition (a table with one row per partition, so its size is
bounded by the partition count and it is safe to broadcast). The sorted table is checkpointed
first so the sample-based range boundaries cannot change between the two passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def hash_id(df: DataFrame, cols: Sequence[str], name: str = "flow_id") -> DataFrame:
    return df.withColumn(name, F.xxhash64(*[F.col(c) for c in cols]))


def dense_id(df: DataFrame, order_cols: Sequence[str], name: str = "flow_id") -> DataFrame:
    """Add ``name`` = 0-based position of each row in ``order_cols`` order (ties broken arbitrarily)."""
    ordered = df.orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
    tagged = cut_lineage(ordered.withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.withColumn("_pid", F.shiftright(F.col("_mid"), _ROW_BITS))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the window below runs over that tiny table only.
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna({"_off": 0})
    out = tagged.join(F.broadcast(offsets), "_pid", "inner")
    low = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return out.withColumn(name, (F.col("_off") + low).cast("long")).drop("_mid", "_pid", "_off")
