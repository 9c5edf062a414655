"""IP address expressions, all native (no Python worker): IPv4 as a dotted quad → long, IPv6
as its eight hextets (``::`` expanded, embedded dotted quad supported)."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values (vendor address ranges used by the reference's heuristics) -----------------
VENDOR_CLOUD_RANGES = ["104.129.192.0/20", "165.225.0.0/17"]
VENDOR_SYNTHETIC_RANGE = "100.64.0.0/10"
# ---------------------------------------------------------------------------------------------

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_to_long(c: Column) -> Column:
    """Dotted-quad IPv4 → 32-bit value as long; null when not a valid IPv4 address."""
    s = c.cast("string")
    parts = F.split(s, r"\.")
    val = (parts[0].cast("long") * 16777216 + parts[1].cast("long") * 65536
           + parts[2].cast("long") * 256 + parts[3].cast("long"))
    return F.when(s.rlike(IPV4_PATTERN), val)


def _v4_bounds(net: ipaddress.IPv4Network) -> tuple[int, int]:
    return int(net.network_address), int(net.broadcast_address)


_HEX4 = r"^[0-9a-f]{1,4}$"


def _empty() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a lambda variable, so the
    expression tree does not grow with every reuse)."""
    return F.transform(F.array(value), body)[0]


def ipv6_hextets(c: Column) -> Column:
    """IPv6 text → array of its 8 hextets as longs (``::`` expanded, a trailing dotted quad
    counted as two hextets); null when the text is not a valid IPv6 address. Native only."""
    def parts(s):
        halves = F.split(s, "::", -1)
        gap = s.contains("::")
        head = F.when(gap, halves[0]).otherwise(s)
        tail = F.when(gap, halves[1]).otherwise(F.lit(""))
        return let(F.struct(gap.alias("gap"), (F.size(halves) - 1).alias("gaps"),
                            F.when(head == "", _empty()).otherwise(F.split(head, ":", -1)).alias("hp"),
                            F.when(tail == "", _empty()).otherwise(F.split(tail, ":", -1)).alias("tp")),
                   lambda p: lists(s, p))

    def lists(s, p):
        last = F.when(F.size(p["tp"]) > 0, F.try_element_at(p["tp"], F.lit(-1))).otherwise(
            F.try_element_at(p["hp"], F.lit(-1)))
        return let(last, lambda last_: dotted(s, p, last_))

    def dotted(s, p, last_):
        return let(ipv4_to_long(last_), lambda v4: expand(s, p, last_, v4))

    def expand(s, p, last_, v4):
        is_dot = F.coalesce(last_.contains("."), F.lit(False))
        v4_parts = F.array(F.lower(F.conv(F.shiftright(v4, 16).cast("string"), 10, 16)),
                           F.lower(F.conv(v4.bitwiseAND(F.lit(65535)).cast("string"), 10, 16)))

        def strip_last(a):
            return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        hp2 = F.when(is_dot & (F.size(p["tp"]) == 0), F.concat(strip_last(p["hp"]), v4_parts)).otherwise(p["hp"])
        tp2 = F.when(is_dot & (F.size(p["tp"]) > 0), F.concat(strip_last(p["tp"]), v4_parts)).otherwise(p["tp"])
        return let(F.struct(hp2.alias("h"), tp2.alias("t"), is_dot.alias("dot"), v4.isNotNull().alias("v4ok")),
                   lambda q: final(s, p, q))

    def final(s, p, q):
        n = F.size(q["h"]) + F.size(q["t"])
        full = F.when(p["gap"], F.concat(q["h"], F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), q["t"])
                      ).otherwise(q["h"])
        return let(full, lambda fl: F.when(
            s.contains(":") & s.rlike(r"^[0-9a-f:.]+$") & (p["gaps"] <= 1)
            & F.forall(fl, lambda x: x.rlike(_HEX4))
            & F.when(p["gap"], n <= 7).otherwise(n == 8) & (~q["dot"] | q["v4ok"])
            & ~s.rlike(r"(^:[^:])|([^:]:$)") & (F.size(fl) == 8),
            F.transform(fl, lambda x: F.conv(x, 16, 10).cast("long"))))

    return let(F.lower(F.trim(c.cast("string"))), parts)


def in_cidr(c: Column, cidr: str) -> Column:
    """address is inside ``cidr`` (v4 or v6, host bits allowed). Null, invalid address or
    invalid network → false."""
    try:
        net = ipaddress.ip_network(str(cidr), strict=False)
    except ValueError:
        return F.lit(False)
    if isinstance(net, ipaddress.IPv4Network):
        lo, hi = _v4_bounds(net)
        return F.coalesce(ipv4_to_long(c).between(lo, hi), F.lit(False))
    net_h = [(int(net.network_address) >> (16 * (7 - i))) & 0xFFFF for i in range(8)]

    def inside(hx):
        cond = F.lit(True)
        for i in range(8):
            bits = min(16, max(0, net.prefixlen - 16 * i))
            if bits == 0:
                break
            mask = (0xFFFF << (16 - bits)) & 0xFFFF
            cond = cond & (hx[i].bitwiseAND(F.lit(mask)) == F.lit(net_h[i] & mask))
        return F.coalesce(hx.isNotNull() & cond, F.lit(False))
    s = c.cast("string")
    return F.when(F.coalesce(s.contains(":"), F.lit(False)), let(ipv6_hextets(s), inside)).otherwise(F.lit(False))


def in_any_cidr(c: Column, cidrs: list[str]) -> Column:
    out = F.lit(False)
    for n in cidrs:
        out = out | in_cidr(c, n)
    return out


def vendor_ip_flags(df: DataFrame, src: str = "source_ip", dst: str = "destination_ip") -> DataFrame:
    """``is_zscaler_ip`` / ``is_zpa_synthetic_ip`` — either end in the ranges; null iff both ends null."""
    both_null = F.col(src).isNull() & F.col(dst).isNull()
    cloud = in_any_cidr(F.col(src), VENDOR_CLOUD_RANGES) | in_any_cidr(F.col(dst), VENDOR_CLOUD_RANGES)
    synth = in_cidr(F.col(src), VENDOR_SYNTHETIC_RANGE) | in_cidr(F.col(dst), VENDOR_SYNTHETIC_RANGE)
    return df.withColumns({"is_zscaler_ip": F.when(~both_null, cloud),
                           "is_zpa_synthetic_ip": F.when(~both_null, synth)})


def _hexstr(c: Column) -> Column:
    return F.lower(F.conv(c.cast("string"), 10, 16))


def ipv6_network48(c: Column) -> Column:
    """/48 network address of an IPv6 address in canonical (RFC 5952) text; null if invalid."""
    def fmt(hx):
        h1, h2, h3 = hx[0], hx[1], hx[2]
        return (F.when(hx.isNull(), F.lit(None).cast("string"))
                .when(h3 != 0, F.concat(_hexstr(h1), F.lit(":"), _hexstr(h2), F.lit(":"), _hexstr(h3), F.lit("::")))
                .when(h2 != 0, F.concat(_hexstr(h1), F.lit(":"), _hexstr(h2), F.lit("::")))
                .when(h1 != 0, F.concat(_hexstr(h1), F.lit("::")))
                .otherwise(F.lit("::")))
    return let(ipv6_hextets(c), fmt)


def anonymize_ip(c: Column, on_invalid: str = "error") -> Column:
    """IPv4 → /24 network address, IPv6 → /48 network address. Invalid text raises (as the
    reference does) unless ``on_invalid="null"``; null stays null."""
    s = c.cast("string")
    v4 = F.concat(F.regexp_extract(s, r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0"))
    bad = F.raise_error(F.concat(F.lit("invalid IP address: "), s)) if on_invalid == "error" else F.lit(None)
    v6 = F.when(s.contains(":"), let(ipv6_network48(s), lambda n: F.coalesce(n, bad.cast("string"))))
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s.rlike(IPV4_PATTERN), v4)
            .when(s.contains(":"), v6)
            .otherwise(bad.cast("string")))
