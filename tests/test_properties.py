"""Property tests: the anonymised network contains the address and equals the
/24 (IPv4) or /48 (IPv6) network address; IPv6 CIDR membership agrees with ``ipaddress``."""

import ipaddress

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netflow_spark.functions.net import anonymize_ip, in_cidr


@settings(max_examples=6, deadline=None)
@given(st.lists(st.ip_addresses(), min_size=1, max_size=60))
def test_anonymized_network_contains_address(spark, addrs):
    texts = [str(a) for a in addrs]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = [r.n for r in df.select(anonymize_ip(F.col("ip")).alias("n")).collect()]
    for a, n in zip(addrs, got):
        bits = 24 if a.version == 4 else 48
        net = ipaddress.ip_network(f"{a}/{bits}", strict=False)
        assert n == str(net.network_address)
        assert a in ipaddress.ip_network(f"{n}/{bits}")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.ip_addresses(v=6), min_size=1, max_size=40), st.integers(min_value=0, max_value=128))
def test_ipv6_cidr_membership(spark, addrs, prefix):
    net = ipaddress.ip_network((addrs[0], prefix), strict=False)
    df = spark.createDataFrame([(str(a),) for a in addrs], "ip string")
    got = [r.m for r in df.select(in_cidr(F.col("ip"), str(net)).alias("m")).collect()]
    assert got == [a in net for a in addrs]
