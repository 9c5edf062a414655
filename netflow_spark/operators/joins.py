"""Point-in-interval join — flows active in a spike second, top ``n`` per spike.

The seconds of a flow's [start, end] are covered exactly by dyadic blocks: at level ``l`` block ``i`` holds the
seconds ``i * 2**l`` up to ``(i + 1) * 2**l``. A flow takes at most two blocks of each level, O(log duration) in all,
and a spike second lies in one block of each level, so the interval join is an equi-join on (level, block) without
a filter behind it. Every flow of a block is active in every second of the block, so only the block's ``n`` largest
flows can be among a spike's: they are chosen before the join, which then yields at most ``n`` rows per spike and
level. ``keys`` (e.g. a capture id) are part of the join and of the ranking. ``row_number() <= n`` is a partial group
limit before each shuffle. Flows without a start or end, and flows between two whole seconds, meet no spike."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPIKE_TOP_FLOWS = 5
#: Levels of blocks: seconds from -2**LEVELS to 2**LEVELS; times beyond are moved to these ends.
LEVELS = 61


def _whole(c: Column) -> Column:
    inside = F.least(F.greatest(c, F.lit(-float(1 << LEVELS))), F.lit(float((1 << LEVELS) - 1024)))
    return F.when(c.isNotNull(), inside.cast("long"))  # greatest and least pass nulls over


def dyadic_blocks(first: Column, last: Column) -> Column:
    """Array of structs ``(level, block)`` that cover the whole numbers ``first`` to ``last`` (longs) once."""
    stop = last + 1
    levels = F.sequence(F.lit(0), F.floor(F.log2((stop - first).cast("double"))).cast("int") + 1)

    def at(level: Column) -> Column:
        # the numbers that are left at this level, rounded inwards to blocks of it
        a, b = -F.call_function("shiftright", -first, level), F.call_function("shiftright", stop, level)
        left = F.when((a < b) & (a.bitwiseAND(F.lit(1)) == 1), F.struct(level.alias("level"), a.alias("block")))
        right = F.when((a < b) & (b.bitwiseAND(F.lit(1)) == 1), F.struct(level.alias("level"), (b - 1).alias("block")))
        return F.array(left, right)
    return F.when(first <= last, F.array_compact(F.flatten(F.transform(levels, at))))


def dyadic_ancestors(second: Column) -> Column:
    """Array of structs ``(level, block)``: the block of each level that holds ``second`` (long)."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS + 1)), lambda level: F.struct(level.alias("level"), F.call_function("shiftright", second, level).alias("block")))


def _top(df: DataFrame, by: Sequence[str], key: Sequence[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("bytes_total").desc(), *[F.col(c).asc() for c in key])
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def spike_top_flows(spikes_df: DataFrame, flows: DataFrame, key: Sequence[str], n: int = SPIKE_TOP_FLOWS,
                    start: str = "start_ts", end: str = "end_ts", second: str = "second", keys: Sequence[str] = ()) -> DataFrame:
    key, keys = list(key), list(keys)
    blocks = dyadic_blocks(_whole(F.ceil(F.col(start).cast("double")).cast("double")), _whole(F.floor(F.col(end).cast("double")).cast("double")))
    f = flows.select(*keys, *key, "bytes_total", F.explode(blocks).alias("_b")).select(*keys, *key, "bytes_total", "_b.level", "_b.block")
    f = _top(f, [*keys, "level", "block"], key, n).drop("rank")
    s = spikes_df.select(*keys, F.col(second).alias("second"))
    s = s.withColumn("_b", F.explode(dyadic_ancestors(F.col("second").cast("long"))))
    j = s.select(*keys, "second", "_b.level", "_b.block").join(f, [*keys, "level", "block"])
    return _top(j, [*keys, "second"], key, n).select(*keys, "second", "rank", *key, "bytes_total")
