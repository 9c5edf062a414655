"""Command line: ``python -m netflow_spark COMMAND --in IN --out OUT``. Runs on whatever master
``spark-submit``/the environment provides.

* ``parse``: captures (a file or folder) to a stored packet table, appended to what is there.
* ``tag``: rule tagging of any flow or packet file, by extension.
* ``flows``: dispositions per flow of a packet table.
* ``report``: the full report of a packet table, one folder of JSON records per report.
"""

from __future__ import annotations

import argparse
import sys


def _arguments() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="netflow_spark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    commands = {name: sub.add_parser(name, help=text) for name, text in (
        ("parse", "store the packets of captures"), ("tag", "tag a flow/packet table with a YAML rule pack"),
        ("flows", "per-flow dispositions from a packet table"), ("report", "all reports of a packet table"))}
    for c in commands.values():
        c.add_argument("--in", dest="inp", required=True)
        c.add_argument("--out", required=True)
    commands["parse"].add_argument("--on-bad", choices=["raise", "skip"], default="raise", help="what to do with damaged captures")
    commands["tag"].add_argument("--rules", default=None, help="rule pack (default: the shipped pack)")
    commands["report"].add_argument("--rules", default=None, help="rule pack (default: the shipped pack)")
    for name in ("flows", "report"):
        commands[name].add_argument("--keys", default="", help="comma-separated key prefix, e.g. capture_file")
    return ap


def _packets(spark, path: str, keys: list[str]):
    """The packets with direction and frame numbers; numbers that are missing are given once and written, so that
    every later branch of a plan sees the same ones."""
    from pyspark.sql import functions as F

    from .operators.orient import ensure_direction
    from .session import cut_lineage
    from .sources.io import read_packets
    packets = read_packets(spark, path)
    if "frame_number" not in packets.columns:
        packets = cut_lineage(packets.withColumn("frame_number", F.monotonically_increasing_id() + 1))
    return ensure_direction(packets, keys)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _arguments().parse_args(argv)
    keys = [k for k in getattr(args, "keys", "").split(",") if k]

    from pyspark.errors import PythonException

    from .rules import RuleFileError, default_rules, tag
    from .session import build_session
    from .sources.capture import read_capture_frames
    from .sources.io import read_flows, save_packets, write_flows
    spark = spark or build_session()
    try:
        if args.cmd == "parse":
            save_packets(read_capture_frames(spark, args.inp, on_bad=args.on_bad).drop("data"), args.out)
        elif args.cmd == "tag":
            write_flows(tag(read_flows(spark, args.inp), args.rules or default_rules()), args.out)
        elif args.cmd == "flows":
            from .operators.disposition import tag_flows
            write_flows(tag_flows(_packets(spark, args.inp, keys), keys=keys), args.out)
        else:
            from .plans.bundle import bundle_json, metrics_bundle
            bundle = metrics_bundle(_packets(spark, args.inp, keys), rules=args.rules, keys=keys)
            bundle_json(bundle).select("record", "report").write.mode("overwrite").partitionBy("report").text(args.out)
    except (RuleFileError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    except PythonException as e:
        said = [line for line in str(e).splitlines() if "CaptureError" in line]
        if not said:
            raise
        print(f"error: {said[-1].strip()}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
