"""IP enrichment from supplied dimension tables (no live lookups).

Addresses and networks are written as hexadecimal text (8 digits for IPv4, 32 for IPv6). Longest-prefix
matching flattens the networks into disjoint ranges first (``longest_prefix``), so that every *distinct*
address takes one as-of lookup inside its bucket. Addresses are de-duplicated first, so the work grows with
distinct addresses, not packets. AQE broadcasts the network side when it is small at runtime.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.net import ipv4_to_long, ipv6_hextets, let

NETWORK_SCHEMA = ("network string, prefix_len int, bits int, lo string, hi string, nation_idx int, country_iso string, "
                  "city string, latitude double, longitude double, asn long, asn_org string")


def networks_table(spark: SparkSession, rows: Sequence[tuple], nation: DataFrame | None = None) -> DataFrame:
    """Network dimension from rows (CIDR, index into ``nation``, ISO code, city, latitude, longitude,
    AS number, AS organisation): (network, prefix_len, bits, lo, hi, country_iso, country, city,
    latitude, longitude, asn, asn_org). Country names come from ``nation`` when given."""
    data = []
    for cidr, idx, iso, city, lat, lon, asn, org in rows:
        net = ipaddress.ip_network(cidr, strict=False)
        digits = net.max_prefixlen // 4
        data.append((cidr, net.prefixlen, net.max_prefixlen, f"{int(net.network_address):0{digits}x}",
                     f"{int(net.broadcast_address):0{digits}x}", idx, iso, city, float(lat), float(lon), int(asn), org))
    df = spark.createDataFrame(data, NETWORK_SCHEMA)
    if nation is not None:
        n = nation.select(F.col("n_nationkey").cast("int").alias("nation_idx"), F.col("n_name").alias("country"))
        df = df.join(n, "nation_idx", "left")
    else:
        df = df.withColumn("country", F.col("country_iso"))
    return df.drop("nation_idx")


def ip_hex(c: Column) -> Column:
    """Address as 8 (IPv4) or 32 (IPv6) hexadecimal digits; null when the text is neither."""
    v4 = F.lower(F.lpad(F.hex(ipv4_to_long(c)), 8, "0"))
    v6 = let(ipv6_hextets(c), lambda h: F.when(h.isNotNull(), F.array_join(F.transform(h, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), "")))
    return F.when(F.coalesce(c.contains(":"), F.lit(False)), v6).otherwise(v4)


def _prefix(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of an address in hexadecimal digits, as digits (the last one masked)."""
    whole, rest = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    nibble = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(m) for m in (0, 8, 12, 14)]), rest + 1)
    return F.concat(F.substring(digits, F.lit(1), whole), F.when(rest > 0, F.lower(F.hex(nibble.bitwiseAND(mask).cast("long")))).otherwise(F.lit("")))


def _next_address(digits: Column) -> Column:
    """The address after one in hexadecimal digits; null after the last."""
    head = F.rtrim(digits, F.lit("f"))
    last = F.conv(F.substring(head, F.length(head), F.lit(1)), 16, 10).cast("long") + 1
    return F.when(F.length(head) > 0, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lower(F.hex(last)),
                                               F.repeat(F.lit("0"), F.length(digits) - F.length(head))))


def _bucket(digits: Column) -> Column:
    """The first 16 bits of an IPv4 address, 48 of an IPv6 address, as digits."""
    return F.when(F.length(digits) == 8, F.substring(digits, 1, 4)).otherwise(F.substring(digits, 1, 12))


def longest_prefix(ips: DataFrame, networks: DataFrame, ip_col: str = "ip") -> DataFrame:
    """For each distinct address in ``ips[ip_col]``: the most specific covering network's columns
    (left join: unmatched or invalid addresses get nulls).

    Nested networks are first flattened into disjoint ranges: a range begins at a network's first address, behind its
    last one, or where a bucket of addresses that are asked for begins (/16, /48); which network a range belongs to
    is found by an equi-join on the prefixes of its first address, one for each prefix length that the networks have
    (at most 162 lengths). Every address then takes one as-of lookup: the range that begins last at or before it in
    its bucket. Only ranges of buckets that are asked for are flattened."""
    net = [c for c in networks.columns if c not in ("bits", "lo", "hi")]
    # an aggregate around the digits: else the optimizer copies the long expression into every use
    d = ips.select(F.col(ip_col).alias("ip")).where(F.col("ip").isNotNull()).distinct().groupBy("ip").agg(F.first(ip_hex(F.col("ip"))).alias("_h"))
    # what is no address lies in buckets without ranges
    bucket = F.coalesce(_bucket(F.col("_h")), F.concat(F.lit("!"), F.pmod(F.xxhash64("ip"), F.lit(4096)).cast("string")))
    d = d.select("ip", F.coalesce("_h", F.lit("")).alias("_h"), F.coalesce(F.length("_h") * 4, F.lit(0)).alias("_bits"), bucket.alias("_bucket"))
    asked = d.select("_bits", "_bucket").distinct()
    ends = networks.select(F.col("bits").alias("_bits"), F.explode(F.array("lo", _next_address(F.col("hi")))).alias("_h")).where("_h is not null")
    starts = ends.distinct().withColumn("_bucket", _bucket(F.col("_h"))).join(asked, ["_bits", "_bucket"], "left_semi")
    starts = starts.unionByName(asked.where("_bits > 0").select("_bits", "_bucket", F.rpad("_bucket", F.expr("_bits div 4"), F.lit("0")).alias("_h"))).distinct()
    lengths = networks.select(F.col("bits").alias("_bits"), F.col("prefix_len").alias("_len")).distinct()
    probes = starts.join(F.broadcast(lengths), "_bits").withColumn("_prefix", _prefix(F.col("_h"), F.col("_len")))
    owners = networks.select(F.col("bits").alias("_bits"), F.col("prefix_len").alias("_len"), _prefix(F.col("lo"), F.col("prefix_len")).alias("_prefix"),
                             F.struct(*net).alias("_n"))
    best = F.max_by("_n", F.when(F.col("_n").isNotNull(), F.struct("_len", F.col("_n.network")))).alias("_n")  # null where no network reaches
    ranges = probes.join(owners, ["_bits", "_len", "_prefix"], "left").groupBy("_bits", "_bucket", "_h").agg(best)
    ranges = ranges.select("_bits", "_bucket", "_h", F.struct("_n").alias("_range"), F.lit(None).cast("string").alias("ip"))
    both = ranges.unionByName(d.select("_bits", "_bucket", "_h", F.lit(None).cast(ranges.schema["_range"].dataType).alias("_range"), "ip"))
    in_order = Window.partitionBy("_bits", "_bucket").orderBy("_h", F.col("ip").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_at", F.last("_range", ignorenulls=True).over(in_order)).where(F.col("ip").isNotNull())
    return found.select("ip", *[F.col(f"_at._n.{c}").alias(c) for c in net])


def ip_geo(ips: DataFrame, networks: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Ip → country, city, latitude, longitude."""
    return longest_prefix(ips, networks, ip_col).select("ip", "country", "city", "latitude", "longitude")


def ip_asn(ips: DataFrame, networks: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Ip → AS number and organisation."""
    return longest_prefix(ips, networks, ip_col).select("ip", F.col("asn").alias("asn_number"),
                                                        F.col("asn_org").alias("asn_organization"))


def ip_country(ips: DataFrame, networks: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Ip → ISO country code."""
    return longest_prefix(ips, networks, ip_col).select("ip", F.col("country_iso"))


def passive_rdns(packets: DataFrame) -> DataFrame:
    """Reverse-DNS dimension derived from the capture itself: every address seen in a DNS answer
    maps to the queried name (the smallest name when several)."""
    if "dns_response_addresses" in packets.columns:
        ans = F.col("dns_response_addresses")
    else:
        ans = F.split(F.col("dns_response_addresses_csv"), ",")
    a = packets.where(F.col("dns_query_name").isNotNull()).select(
        F.explode(ans).alias("ip"), F.col("dns_query_name").alias("name"))
    a = a.where(F.trim("ip") != "").select(F.trim("ip").alias("ip"), "name")
    return a.groupBy("ip").agg(F.min("name").alias("rdns"))


def ip_rdns(ips: DataFrame, rdns: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Ip → reverse-DNS name from a supplied (ip, rdns) table; unknown → null."""
    d = ips.select(F.col(ip_col).alias("ip")).where(F.col("ip").isNotNull()).distinct()
    return d.join(rdns.select("ip", "rdns"), "ip", "left")


def enrich_ips(ips: DataFrame, networks: DataFrame, rdns: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Geo + ASN + rDNS per distinct address."""
    lp = longest_prefix(ips, networks, ip_col)
    r = rdns.select("ip", "rdns")
    return lp.join(r, "ip", "left").select(
        "ip", "country", "city", "latitude", "longitude", F.col("asn").alias("asn_number"),
        F.col("asn_org").alias("asn_organization"), "rdns")


def with_dest_country(flows: DataFrame, networks: DataFrame, ip_col: str) -> DataFrame:
    """Add ``dest_country`` (ISO) and ``is_unusual_country`` to each flow."""
    from .metrics import COMMON_COUNTRIES
    c = ip_country(flows.select(F.col(ip_col).alias("ip")), networks)
    j = flows.join(c.withColumnRenamed("ip", ip_col), ip_col, "left").withColumnRenamed("country_iso", "dest_country")
    return j.withColumn("is_unusual_country", F.col("dest_country").isNotNull() & ~F.col("dest_country").isin(COMMON_COUNTRIES))
