"""Exact dedup: two-pass Bloom filtering.

The first pass turns every text into its SHA-256 and gathers a Bloom filter of the hashes that may
occur more than once; the second tests every row against it. Only rows that may be repeated are
shuffled; the rest pass straight through. The filter has a fixed largest size: with far more
documents than bits more rows are shuffled, and the result stays exact.

Texts are equal when identical after ``normalize`` (nothing by default). Null text counts as empty.
Of equal texts the row with the largest id stays; null ids lose against any id. Rows that repeat
both id and text share one decision; ``drop_exact_copies`` can leave one of them. Empty tables give
empty results. Columns other than the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bloom_words, id_and_text, mark_members, written


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def hashed(docs: DataFrame, id_col: str, text_col: str, normalize: Callable[[Column], Column] | None) -> DataFrame:
    text = F.col("_text") if normalize is None else F.coalesce(normalize(F.col("_text")), F.lit(""))
    return id_and_text(docs, id_col, text_col).select("_id", content_hash(text).alias("_sha"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                normalize: Callable[[Column], Column] | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id`` (the id that stays), ``group_size``, ``kept``, ``text_sha256``."""
    rows = written(hashed(docs, id_col, text_col, normalize), "hashes")
    words = written(bloom_words(rows, "_sha", filter_bits, repeated=True), "bloom")
    marked = mark_members(rows, F.col("_sha"), words, "_maybe", filter_bits)
    alone = marked.where(~F.col("_maybe")).select("_id", "_sha", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"))
    maybe = marked.where("_maybe").select("_id", "_sha")
    # written, so that both sides of the join are shuffled anew and a hot hash can be split
    groups = written(maybe.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")), "groups")
    both = alone.unionByName(maybe.join(groups, "_sha").select("_id", "_sha", "_keep", "_n"))
    return both.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
                       F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      filter_bits: int = FILTER_BITS, one_each: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; whole rows move only if they may be repeated.

    ``one_each``: of rows that repeat both id and text (null ids count as one id) one stays, any of them.
    """
    cols = docs.columns
    rows = written(hashed(docs, id_col, text_col, None), "hashes")
    words = written(bloom_words(rows, "_sha", filter_bits, repeated=True), "bloom")
    maybe = mark_members(rows, F.col("_sha"), words, "_maybe", filter_bits).where("_maybe")
    keep = written(maybe.groupBy("_sha").agg(F.max("_id").alias("_keep")), "keepers")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"),
                        content_hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_sha"))
    marked = mark_members(whole, F.col("_sha"), words, "_maybe", filter_bits)
    row_id = F.col(f"_row.`{id_col}`")
    maybe = marked.where("_maybe").select("_row", "_sha", row_id.alias("_keep"))
    if one_each:
        # before the join: rows that repeat go where they are read, however many
        maybe = maybe.dropDuplicates(["_keep", "_sha"])
    # a keeper is met by its own id, so no text that has many copies gathers in one task
    kept = maybe.alias("l").join(keep.alias("r"), F.expr("l._keep <=> r._keep and l._sha = r._sha"), "left_semi")
    out = marked.where(~F.col("_maybe")).select("_row").unionByName(kept.select("_row"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in cols])
