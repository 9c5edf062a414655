"""Exact quantiles without gathering a group's values in one task.

Spark's exact ``percentile`` merges a map of every distinct value of a group in a single task (fine
for thousands of samples, not for billions). Here a wanted rank is found by narrowing a range: the
distinct values with their counts are shuffled once; each of ``LEVELS`` passes over them counts the
values in ``BINS`` equal parts of every wanted rank's range and goes on with the part that holds it.
A pass keeps at most ``BINS`` rows per rank, and the parts left after the last pass are so narrow
(``BINS ** -LEVELS`` of the group's range) that a window over what they hold finds the value.
Interpolation is linear between closest ranks (numpy's default): v[lo] + (v[hi] − v[lo])·frac.

The plan is lazy and the same for every input; all passes read the same shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, LEVELS = 1 << 16, 2


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], keys: Sequence[str] = (),
                    prefix: str = "q") -> DataFrame:
    """One row per key group (only groups with values): ``n`` and ``{prefix}{i}`` per prob."""
    keys = list(keys)
    v = df.select(*keys, F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counted = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    stats = counted.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        wanted += [F.struct(F.lit(2 * i).alias("w"), F.floor(pos).cast("long").alias("t")),
                   F.struct(F.lit(2 * i + 1).alias("w"), F.ceil(pos).cast("long").alias("t"))]
    # one row per wanted rank: the t-th value (from 0) among those from _lo to _hi
    state = stats.select(*keys, "_lo", "_hi", F.explode(F.array(*wanted)).alias("_s")).select(
        *keys, "_lo", "_hi", F.col("_s.w").alias("_w"), F.col("_s.t").alias("_t"))
    rank = [*keys, "_w"]

    def inside(state: DataFrame) -> DataFrame:
        # without keys the state has one row per wanted rank: a proven size
        s = state if keys else F.broadcast(state)
        return (counted.join(s, keys) if keys else counted.crossJoin(s)).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    upto = Window.partitionBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(LEVELS):
        part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS)).otherwise(F.lit(0))
        bins = inside(state).groupBy(*rank, "_t", part.alias("_part")).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        bins = bins.withColumn("_upto", F.sum("_c").over(upto.orderBy("_part")))
        state = bins.where((F.col("_t") < F.col("_upto")) & (F.col("_t") >= F.col("_upto") - F.col("_c"))).select(
            *rank, "_lo", "_hi", (F.col("_t") - (F.col("_upto") - F.col("_c"))).alias("_t"))
    last = inside(state).withColumn("_upto", F.sum("_c").over(upto.orderBy("_v")))
    found = last.where((F.col("_t") < F.col("_upto")) & (F.col("_t") >= F.col("_upto") - F.col("_c")))
    values = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_w") == w, F.col("_v"))).alias(f"_v{w}") for w in range(2 * len(probs))])
    out = stats.select(*keys, "n")
    out = out.join(values, keys) if keys else out.crossJoin(F.broadcast(values)).where("n is not null")
    return out.select(*keys, "n", *[
        (F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}"))
         * (F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1)))).alias(f"{prefix}{i}")
        for i, p in enumerate(probs)])
