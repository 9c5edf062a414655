"""Reading and writing packet and flow tables.

Everything is a plain DataFrame reader/writer: the schema is applied at read time so missing
columns come back as nulls; the physical format is chosen by extension. Nothing goes through
the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import normalize_packets
from ..schema import PACKET_SCHEMA, WIRE_KEY

_ARRAY_COLS = [f.name for f in PACKET_SCHEMA.fields if isinstance(f.dataType, T.ArrayType)]


def _ext(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")


# Columns that operators name without asking whether they are there.
_ALWAYS = {"timestamp", "packet_length", *WIRE_KEY}


def conform(df: DataFrame, schema: T.StructType = PACKET_SCHEMA, keep_extra: bool = True, fill: bool = False) -> DataFrame:
    """Cast to the packet schema; text lists → arrays. Of absent columns only the wire key, time and
    length are added as typed nulls, or all of them with ``fill``."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            src = df.schema[f.name].dataType
            if isinstance(f.dataType, T.ArrayType) and isinstance(src, T.StringType):
                c = F.filter(F.transform(F.split(F.col(f.name), ","), lambda x: F.trim(x)), lambda x: x != "")
            elif isinstance(f.dataType, T.BooleanType) and isinstance(src, T.StringType):
                s = F.lower(F.trim(F.col(f.name)))
                c = F.when(s.isin("true", "1"), F.lit(True)).when(s.isin("false", "0"), F.lit(False))
            else:
                c = F.col(f.name).try_cast(f.dataType) if not isinstance(f.dataType, T.ArrayType) else F.col(f.name).cast(f.dataType)
            cols.append(c.alias(f.name))
        elif fill or f.name in _ALWAYS:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in schema.fieldNames()] if keep_extra else []
    return df.select(*cols, *extra)


def read_packets(spark: SparkSession, path: str, fmt: str | None = None, normalize: bool = True, fill: bool = False) -> DataFrame:
    """Dissected packet table from CSV / JSON / Parquet, conformed to ``PACKET_SCHEMA``."""
    fmt = (fmt or _ext(path) or "parquet").lower()
    if fmt == "csv":
        raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
        if normalize:
            raw = normalize_packets(raw)
    elif fmt == "json":
        raw = spark.read.json(path)
    else:
        raw = spark.read.parquet(path)
    return conform(raw, fill=fill)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow table by extension; a JSON file holds one array of records."""
    ext = _ext(path)
    if ext == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if ext == "json":
        # One JSON array of records (the reference's format) or JSON lines (Spark's own output).
        return spark.read.option("multiLine", _is_json_array(spark, path)).json(path)
    if ext == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported input file extension: .{ext}. Use .parquet, .csv or .json.")


def _is_json_array(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank opens an array; read by Spark, so any store will do."""
    first = spark.read.text(path).where("trim(value) <> ''").take(1)
    return bool(first) and first[0].value.lstrip().startswith("[")


def write_flows(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Flow table by extension (CSV with header, no index)."""
    ext = _ext(path)
    if ext == "csv":
        out = df
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
                out = out.withColumn(f.name, F.to_json(F.col(f.name)))
        out.write.mode(mode).option("header", True).csv(path)
    elif ext == "json":
        df.write.mode(mode).json(path)
    elif ext == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"Unsupported output file extension: .{ext}. Use .parquet, .csv or .json.")


def save_packets(df: DataFrame, path: str | None = None, table: str | None = None, mode: str = "append",
                 partition_by: list[str] | None = None) -> None:
    """Store packets (append by default, like chunked ingest) as Parquet or a table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if table:
        w.saveAsTable(table)
    else:
        w.parquet(path)


def packet_count(df: DataFrame) -> int:
    return df.count()


def head(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.limit(limit)


def slice_frames(df: DataFrame, start: int = 0, size: int | None = None, max_packets: int | None = None) -> DataFrame:
    """Frames ``start+1 .. start+size`` (pushed down to the scan), at most ``max_packets``
    of them in frame order."""
    out = df.where(F.col("frame_number") > start)
    if size is not None:
        out = out.where(F.col("frame_number") <= start + size)
    if max_packets is not None:
        out = out.orderBy("frame_number").limit(max_packets)
    return out


def export_by_protocol(summary: DataFrame, path: str, mode: str = "overwrite", fmt: str = "csv") -> None:
    """One directory per protocol (``protocol=<name>``); an empty name becomes ``UNKNOWN``."""
    p = F.when(F.coalesce(F.col("protocol"), F.lit("")) == "", F.lit("UNKNOWN")).otherwise(F.col("protocol"))
    out = summary.withColumn("protocol", p)
    w = out.write.mode(mode).partitionBy("protocol")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def export_records(flows: DataFrame, capture_info: dict | None = None) -> DataFrame:
    """One JSON record per flow (``record``), with the capture info attached as JSON."""
    info = F.lit(None).cast("string") if not capture_info else F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in capture_info.items()]))
    return flows.select(F.to_json(F.struct("*")).alias("record"), info.alias("capture_info"))
