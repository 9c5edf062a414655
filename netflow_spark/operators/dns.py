"""DNS answer vs TLS destination (interval join, 0 ≤ Δt ≤ 60 s) without pairing rows.

For a TLS row (client, SNI, server, t) the reference unions the answers of every DNS row with
the same (client, name) in [t−60, t] and flags a mismatch when that union is non-empty and
does not hold the server. Both halves are as-of lookups, so we never emit DNS×TLS pairs:

* any answer in the window  ⇔ the latest answered DNS row at or before t is ≥ t−60;
* server among the answers ⇔ the latest DNS row at or before t whose answers contain the
  server (answers exploded to one row per address) is ≥ t−60.

Both use the skew-safe blocked as-of join (time axis cut into ``block`` second buckets; the carry
from earlier buckets is one row per key and second with rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import dns_answers
from ..functions.columns import first_column, first_present, with_oriented_key
from ..schema import FLOW_KEY
from ..session import cut_lineage
from .asof import asof_latest

DNS_TLS_MAX_AGE_SECONDS = 60  # fixed value
# A task holds at most what one client and name send in this many seconds.
_TIME_BLOCK_SECONDS = 1


def _answers(df: DataFrame):
    if "dns_response_addresses" in df.columns:
        dt = df.schema["dns_response_addresses"].dataType
        return dns_answers(F.col("dns_response_addresses"), is_array=isinstance(dt, T.ArrayType))
    if "dns_response_addresses_csv" in df.columns:
        return dns_answers(F.col("dns_response_addresses_csv"))
    return None


def dns_sni_checks(rows: DataFrame, keys: Sequence[str] = (), id_col: str = "frame_number",
                   max_age: float = DNS_TLS_MAX_AGE_SECONDS, block: float = _TIME_BLOCK_SECONDS,
                   materialize: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Per TLS row (port 443 with SNI) that has a DNS answer for its (client, name) within
    ``max_age`` seconds before it: ``id_col``, client, sni, server and ``mismatch`` (and the
    ``carry`` columns of the row)."""
    keys, carry = list(keys), list(carry)
    src = first_column(rows, ["src_ip", "source_ip", "client_ip"])
    dst = first_column(rows, ["dest_ip", "destination_ip", "server_ip"])
    port = first_column(rows, ["dest_port", "destination_port", "server_port"], "long")
    ts = first_column(rows, ["timestamp", "start_time", "first_syn_time"], "double").cast("double")
    sni = first_present(rows, ["sni", "server_name_indication"])
    ans = _answers(rows)
    if ans is None or "dns_query_name" not in rows.columns:
        return rows.sparkSession.createDataFrame(
            [], f"{id_col} long, client string, sni string, server string, mismatch boolean")
    base = rows.select(*keys, *[F.col(c).alias(f"_carry_{c}") for c in carry], F.col(id_col).alias("_id"), src.alias("_src"), dst.alias("_dst"), port.alias("_port"),
                       ts.alias("_t"), sni.alias("_sni"), F.col("dns_query_name").alias("_q"), ans.alias("_ans"))
    is_dns = (F.col("_port") == 53) & F.col("_q").isNotNull() & F.col("_t").isNotNull() & F.col("_src").isNotNull()
    is_tls = (F.col("_port") == 443) & F.col("_sni").isNotNull() & F.col("_t").isNotNull()
    if materialize:
        # The narrow DNS+TLS subset is written once; both as-of lookups read it (the packet
        # table is scanned once instead of four times).
        base = cut_lineage(base.where(is_dns | is_tls))
    dns = base.where(is_dns)
    tls = base.where(is_tls)
    k = [*keys, "_src", "_name"]
    answered = dns.where(F.size("_ans") > 0).select(*keys, "_src", F.col("_q").alias("_name"), "_t",
                                                    F.col("_t").alias("_any_t"))
    per_ip = dns.select(*keys, "_src", F.col("_q").alias("_name"), "_t", F.explode("_ans").alias("_ip")) \
        .select(*keys, "_src", "_name", "_ip", "_t", F.col("_t").alias("_hit_t"))
    carried = [f"_carry_{c}" for c in carry]
    probe = tls.select(*keys, *carried, "_id", "_src", F.col("_sni").alias("_name"), "_dst", "_t")
    a = asof_latest(probe, answered, k, "_t", "_any_t", block=block, strict=False, materialize=False)
    a = a.withColumn("_ip", F.col("_dst"))
    b = asof_latest(a, per_ip, [*k, "_ip"], "_t", "_hit_t", block=block, strict=False, materialize=False)
    in_window = F.col("_any_t").isNotNull() & ((F.col("_t") - F.col("_any_t")) <= max_age)
    hit = F.col("_hit_t").isNotNull() & ((F.col("_t") - F.col("_hit_t")) <= max_age)
    return b.where(in_window).select(*keys, *[F.col(f"_carry_{c}").alias(c) for c in carry], F.col("_id").alias(id_col), F.col("_src").alias("client"),
                                     F.col("_name").alias("sni"), F.col("_dst").alias("server"),
                                     (~hit).alias("mismatch"))


def dns_sni_mismatch_flows(packets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Oriented flows that contain a mis-routed TLS packet (for ``tag_flows(with_app_fields=True)``)."""
    # The flow key travels with the row, so that no join has to find it again by frame.
    checks = dns_sni_checks(with_oriented_key(packets), keys, carry=FLOW_KEY)
    return checks.where("mismatch").select(*keys, *FLOW_KEY).distinct()
