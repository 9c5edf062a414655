"""Every training-data query runs over its whole table; the network part's queries are tested elsewhere."""

import pytest

from netflow_spark.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_small(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    df.write.format("noop").mode("overwrite").save()
    assert len(df.columns) > 0 and "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()


def test_oracles_are_of_queries():
    assert set(ORACLE) <= set(QUERIES) and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
