"""Configurable runs as a checked list of named steps.

A step is a DataFrame → DataFrame operator from ``known_steps()`` (a fixed table: a configuration can
name operators, never import code) with keyword parameters. A run applies its steps in order; the
result is one lazy plan for Catalyst. A configuration lists steps under ``processors``, ``analyzers``
and ``reporters``, taken in that order; whether a step exists and takes the parameters given is
checked when the configuration is read, before any data is touched.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path
from typing import Any, NamedTuple

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("processors", "analyzers", "reporters")
_FLOW = ("src_ip", "dest_ip", "src_port", "dest_port", "protocol")


class Step(NamedTuple):
    name: str
    params: Mapping[str, Any] = {}


class StepError(ValueError):
    """A step list that can't be run: says which entry and why."""


def known_steps() -> dict[str, dict[str, Callable[..., DataFrame]]]:
    """Kind → name → operator."""
    from ..functions import classify as cl
    from ..functions.decode import decode_names
    from ..functions.net import anonymize_ip, vendor_ip_flags
    from ..functions.normalize import canonical_columns, fill_int_columns, normalize_packets
    from ..operators import disposition, features, flow_table, metrics, ordered, orient
    from ..rules import default_rules, tag
    from ..sources.io import write_flows

    def anonymize(df, columns=("source_ip", "destination_ip"), on_invalid="error"):
        return df.withColumns({c: anonymize_ip(F.col(c), on_invalid) for c in columns})

    def reason(df):
        return df.withColumn("packet_error_reason", cl.packet_error_reason(df))

    def l7(df):
        return df.withColumn("l7_protocol_guess", cl.guess_l7(df))

    def rules(df, path=None):
        return tag(df, path or default_rules())

    def flow_rules(df, path=None, keys=()):
        return features.tagged_flows(df, path, keys)

    def largest(df, n=20, key=_FLOW):
        return metrics.top_by(df, "bytes_total", list(key), n)

    def notable(df, n=20, key=_FLOW):
        return metrics.top_flows(df, list(key), n)

    def write(df, path):
        write_flows(df, path)
        return df

    return {
        "processors": {
            "normalize": normalize_packets, "canonical_columns": canonical_columns, "fill_ints": fill_int_columns,
            "decode_names": decode_names, "vendor_ip_flags": vendor_ip_flags, "orient": orient.orient_packets,
            "orient_parser": orient.orient_parser, "ensure_direction": orient.ensure_direction,
            "tcp_heuristics": ordered.with_heuristic_flags, "packet_error_reason": reason, "l7_guess": l7, "anonymize": anonymize,
        },
        "analyzers": {
            "tag": rules, "tag_flows": disposition.tag_flows, "tagged_flows": flow_rules, "flow_table": flow_table.flow_table,
            "flow_sparklines": flow_table.flow_sparklines, "flow_summary": flow_table.flow_summary,
            "rule_features": features.rule_features, "timeline": metrics.timeline, "protocol_counts": metrics.protocol_counts,
            "tls_versions": metrics.tls_versions, "handshake_rtt": ordered.handshake_rtt,
        },
        "reporters": {
            "top_by_bytes": largest, "top_flows": notable, "error_summary": metrics.error_summary,
            "security_findings": metrics.security_findings, "outcome_by_protocol": metrics.outcome_by_protocol, "write": write,
        },
    }


def _operator(kind: str, step: Step, known: dict) -> Callable[..., DataFrame]:
    if step.name not in known[kind]:
        raise StepError(f"{kind}: there is no step called {step.name!r}; choose from {', '.join(sorted(known[kind]))}")
    op = known[kind][step.name]
    try:
        inspect.signature(op).bind(None, **step.params)
    except TypeError as e:
        raise StepError(f"{kind}: {step.name} can't take {dict(step.params)}: {e}") from None
    return op


def parse_steps(config: Mapping[str, Any]) -> list[tuple[str, Step]]:
    """Checked (kind, step) list of a configuration. Entries are names or ``{name, params}``."""
    if not isinstance(config, Mapping):
        raise StepError("a step configuration maps processors, analyzers and reporters to lists")
    known, out = known_steps(), []
    for kind in KINDS:
        for at, entry in enumerate(config.get(kind) or []):
            if isinstance(entry, Mapping):
                step = Step(entry.get("name") or "", dict(entry.get("params") or {}))
            else:
                step = Step(entry)
            if not isinstance(step.name, str) or not step.name:
                raise StepError(f"{kind}: entry {at + 1} has no name: {entry!r}")
            _operator(kind, step, known)
            out.append((kind, step))
    return out


def read_steps(path: str | Path) -> list[tuple[str, Step]]:
    """The step list of a YAML or JSON file."""
    p = Path(path)
    readers = {".yaml": yaml.safe_load, ".yml": yaml.safe_load, ".json": json.loads}
    if p.suffix.lower() not in readers:
        raise StepError(f"{p.name}: step files are YAML or JSON")
    return parse_steps(readers[p.suffix.lower()](p.read_text(encoding="utf-8")) or {})


def run_steps(df: DataFrame, steps: Iterable[tuple[str, Step]], on_progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """``df`` through every step in order."""
    known, steps = known_steps(), list(steps)
    for done, (kind, step) in enumerate(steps, 1):
        df = _operator(kind, step, known)(df, **step.params)
        if on_progress:
            on_progress(done, len(steps))
    return df
