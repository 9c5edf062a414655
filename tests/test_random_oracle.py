"""Every packet query vs its DuckDB oracle on a random packet table (nulls, missing directions,
odd flag combinations, timestamp ties, ICMP quoting) — the differential check of
scripts/check_random.py on one seed."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_oracle import rows_of  # noqa: E402
from random_packets import write  # noqa: E402


def test_random_packets_match_oracles(spark, tmp_path):
    import __spark_entry__ as e
    from netflow_spark.fixtures import PACKETS_PATH_CONF
    from netflow_spark.plans.oracle import RAW
    from tests.conftest import SF_SMALL
    path = str(tmp_path / "packets.parquet")
    write(path, 400, 11)
    con = duckdb.connect()
    for t in ("nation", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    con.execute(f"CREATE VIEW packets AS SELECT * FROM read_parquet('{path}')")
    qs = e.queries()
    spark.conf.set(PACKETS_PATH_CONF, path)
    try:
        for name in sorted(k for k, sql in RAW.items() if "packets" in sql and k in qs):
            sdf = qs[name](spark, SF_SMALL)
            got = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
            res = con.execute(RAW[name])
            cols = [d[0] for d in res.description]
            assert sorted(sdf.columns) == sorted(cols), name
            assert got == rows_of(cols, res.fetchall()), name
    finally:
        spark.conf.unset(PACKETS_PATH_CONF)
