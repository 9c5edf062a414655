"""Spark-native analytics for network captures: flows, rules, dispositions and metrics as
DataFrame → DataFrame operators (batch and Structured Streaming)."""

__version__ = "0.1.0"

__all__ = ["tag_flows", "tag", "load_rules", "default_rules", "read_packets", "read_flows", "write_flows",
           "flow_table", "flow_summary", "orient_packets", "ensure_direction", "metrics_bundle", "bundle_json", "read_steps", "parse_steps", "run_steps"]


def __getattr__(name):  # lazy: importing the package does not start or touch Spark
    if name == "tag_flows":
        from .operators.disposition import tag_flows
        return tag_flows
    if name in ("tag", "load_rules", "default_rules"):
        from . import rules
        return getattr(rules, name)
    if name in ("read_packets", "read_flows", "write_flows"):
        from .sources import io
        return getattr(io, name)
    if name in ("flow_table", "flow_summary"):
        from .operators import flow_table
        return getattr(flow_table, name)
    if name in ("orient_packets", "ensure_direction"):
        from .operators import orient
        return getattr(orient, name)
    if name in ("metrics_bundle", "bundle_json"):
        from .plans import bundle
        return getattr(bundle, name)
    if name in ("read_steps", "parse_steps", "run_steps"):
        from .plans import steps
        return getattr(steps, name)
    raise AttributeError(name)
