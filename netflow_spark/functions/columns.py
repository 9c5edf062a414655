"""Small Column-expression helpers shared by operators (all JVM-side, no Python UDF)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def opt(df: DataFrame, name: str, dtype: str | T.DataType = "string") -> Column:
    """``df[name]`` if the column exists, else a typed null (the reference's ``df.get``)."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def first_present(df: DataFrame, names: Sequence[str], dtype: str | T.DataType = "string") -> Column:
    """Per row, the first of the columns ``names`` that holds a value (not the first that exists:
    a table conformed to the packet schema has them all)."""
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast(dtype)


def flag(df: DataFrame, name: str) -> Column:
    """Boolean column with null (or missing) read as false."""
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)


def first_column(df: DataFrame, names: Sequence[str], dtype: str | T.DataType = "string") -> Column:
    """The first of the columns ``names`` that exists: for names of which a table has one family only."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None).cast(dtype))


def has_direction(df: DataFrame) -> bool:
    return "is_source_client" in df.columns or "is_src_client" in df.columns


def direction(df: DataFrame) -> Column:
    """Packet goes client→server, chosen per row from ``is_source_client`` and ``is_src_client``."""
    if not has_direction(df):
        raise ValueError("packets have no direction: add is_source_client, e.g. with orient_packets")
    return first_present(df, ["is_source_client", "is_src_client"], "boolean").cast("boolean")


def is_client(df: DataFrame) -> Column:
    """Packet goes client→server (null direction is neither)."""
    return direction(df).eqNullSafe(F.lit(True))


def is_server(df: DataFrame) -> Column:
    return direction(df).eqNullSafe(F.lit(False))


def with_oriented_key(df: DataFrame) -> DataFrame:
    """Add ``client_ip, server_ip, client_port, server_port``; a null direction reads server→client."""
    o = direction(df)
    return df.withColumns({
        "client_ip": F.when(o, F.col("source_ip")).otherwise(F.col("destination_ip")),
        "server_ip": F.when(o, F.col("destination_ip")).otherwise(F.col("source_ip")),
        "client_port": F.when(o, F.col("source_port")).otherwise(F.col("destination_port")),
        "server_port": F.when(o, F.col("destination_port")).otherwise(F.col("source_port")),
    })


def all_not_null(cols: Iterable[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def bool_any(cond: Column) -> Column:
    """Aggregate: does any row satisfy ``cond`` (null rows count as false)."""
    return F.max(F.coalesce(cond, F.lit(False)))


def min_when(cond: Column, value: Column) -> Column:
    return F.min(F.when(F.coalesce(cond, F.lit(False)), value))


def null_safe_join_cond(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond
