"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The packets view is first derived from ``events`` and stored as Parquet once (reported as
``ingest_packets``), as an ingest job would; the headline queries then read that stored table.
Each query is executed completely through the ``noop`` sink (no collect to the driver); the
first run of the session (JVM warm-up) is excluded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["tag_flows", "flow_table", "flow_summary", "rules_disposition", "tcp_heuristics",
            "icmp_correlate", "dns_sni_mismatch", "performance_summary", "timeline_spikes", "enrich_ips",
            "top_flows", "rule_features", "rtt_samples", "packet_rtt"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from netflow_spark.plans.queries import all_queries
    from netflow_spark.session import build_session
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    from netflow_spark.fixtures import PACKETS_PATH_CONF, store_packets
    import tempfile
    qs = all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    qs["flow_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    stored = os.path.join(tempfile.mkdtemp(prefix="run-", dir=os.environ.get("BENCH_TMP", "/tmp")), "packets")
    t0 = time.perf_counter()
    store_packets(spark, sf_dir, stored)
    times["ingest_packets"] = round(time.perf_counter() - t0, 3)
    spark.conf.set(PACKETS_PATH_CONF, stored)
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf_text = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf_text)
    except ValueError:
        sf = sf_text
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
