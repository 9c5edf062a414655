"""Typing and naming of raw packet columns (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INT_FILL_VALUES

_DEC = r"[1-9][0-9]*|0+"


def parse_int_text(c: Column) -> Column:
    """Integer from text — commas dropped, surrounding blanks ignored, optional sign,
    ``0x``/``0o``/``0b`` prefixes; leading zeros, decimals and anything else give null."""
    s = F.trim(F.regexp_replace(c.cast("string"), ",", ""))
    sign = F.when(s.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    body = F.regexp_replace(s, r"^[+-]", "")
    low = F.lower(body)
    digits = F.substring(low, 3, 1 << 20)

    def based(base: int) -> Column:
        return F.conv(digits, base, 10).try_cast("long")
    val = (F.when(body.rlike(rf"^({_DEC})$"), body.try_cast("long"))
           .when(low.rlike(r"^0x[0-9a-f]+$"), based(16))
           .when(low.rlike(r"^0o[0-7]+$"), based(8))
           .when(low.rlike(r"^0b[01]+$"), based(2)))
    ok = s.rlike(r"^[+-]?[0-9a-zA-Z]+$")
    return F.when(ok, val * sign)


def parse_bool_text(c: Column) -> Column:
    """true/1 → true, false/0 → false, anything else → null."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1"), F.lit(True)).when(s.isin("false", "0"), F.lit(False))


def int_or_default(c: Column, default: int = 0) -> Column:
    """Integer value, or ``default`` when missing or not numeric."""
    return F.coalesce(c.try_cast("double").try_cast("long"), F.lit(default))


def _plain_int(c: Column) -> Column:
    return F.trim(F.regexp_replace(c.cast("string"), ",", "")).try_cast("long")


def normalize_packets(df: DataFrame) -> DataFrame:
    """Frame → long (default 0), timestamp → double (default 0.0); port and stream columns
    given as text (possibly with thousands separators) become integers."""
    out = {}
    if "frame_number" in df.columns:
        out["frame_number"] = F.coalesce(_plain_int(F.col("frame_number")), F.lit(0).cast("long"))
    if "timestamp" in df.columns:
        out["timestamp"] = F.coalesce(F.col("timestamp").try_cast("double"), F.lit(0.0))
    for c in ("source_port", "destination_port", "tcp_stream_index"):
        if c in df.columns:
            dt = df.schema[c].dataType
            out[c] = _plain_int(F.col(c)) if isinstance(dt, T.StringType) else F.col(c).cast("long")
    return df.withColumns(out) if out else df


def fill_int_columns(df: DataFrame, fill: dict[str, int] | None = None) -> DataFrame:
    """Replace nulls in the known integer columns by their sentinels."""
    fill = fill or INT_FILL_VALUES
    present = {c: v for c, v in fill.items() if c in df.columns}
    return df.na.fill(present) if present else df


# Fixed alias names accepted on input.
COLUMN_ALIASES = {"src_ip": "source_ip", "dest_ip": "destination_ip",
                  "src_port": "source_port", "dest_port": "destination_port"}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Alias names → canonical names (only when the canonical 4-tuple is incomplete),
    default ``timestamp`` = 0 and ``is_source_client`` = true when absent."""
    canon = {"source_ip", "destination_ip", "source_port", "destination_port"}
    if not canon.issubset(df.columns):
        ren = {k: v for k, v in COLUMN_ALIASES.items() if k in df.columns and v not in df.columns}
        if ren:
            df = df.withColumnsRenamed(ren)
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.lit(0).cast("double"))
    if "is_source_client" not in df.columns and "is_src_client" not in df.columns:
        df = df.withColumn("is_source_client", F.lit(True))
    return df
