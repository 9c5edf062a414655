"""Physical-plan guards: pruned scans and partial group limits for per-group top-k (the
no-Python-UDF / no-Cartesian guard runs over every query in test_end_to_end)."""

import pytest

from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as e
    q = e.queries()
    return {name: _plan(q[name](spark, SF_SMALL)) for name in ("error_summary", "spike_top_flows", "top_by_bytes")}


def test_scans_are_pruned(spark):
    from netflow_spark.fixtures import packets
    from netflow_spark.operators.flow_table import flow_table
    p = flow_table(packets(spark, SF_SMALL))
    text = p._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text


def test_group_top_k_is_partial(plans):
    assert "WindowGroupLimit" in plans["error_summary"]
    assert "WindowGroupLimit" in plans["spike_top_flows"]
    assert "TakeOrderedAndProject" in plans["top_by_bytes"]


@pytest.mark.parametrize("name", ["flow_summary", "top_flows", "error_summary", "error_total", "security_total", "service_overview", "rules_outcome"])
def test_generated_code_compiles(spark, name):
    """Without the fallback, code that exceeds the JVM's method size is an error."""
    import __spark_entry__ as e
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        e.queries()[name](spark, SF_SMALL).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_operators_are_lazy(spark):
    """Building a plan runs no job (dense ids aside, which are fixed by one pass)."""
    from netflow_spark.fixtures import packets
    from netflow_spark.operators import dns, metrics, ordered
    from netflow_spark.operators.disposition import tag_flows
    p = packets(spark, SF_SMALL)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    spark.sparkContext.setJobGroup("build", "build")
    metrics.performance_summary(ordered.handshake_rtt(p), ordered.tls_time_to_alert(p), ordered.retransmissions(p), p)
    dns.dns_sni_checks(p)
    tag_flows(p, flow_id="hash", with_app_fields=True)
    assert before >= 0 and list(tracker.getJobIdsForGroup("build")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
