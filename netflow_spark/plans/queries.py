"""Registered queries over the driver's tables (``packets`` is a view over ``events``).

Every query reads whole tables; limits appear only where the operator is a top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import packets
from ..operators import disposition as disp
from .registry import QUERIES, query


@query("tag_flows")
def q_tag_flows(spark: SparkSession, sf: str) -> DataFrame:
    return disp.tag_flows(packets(spark, sf))


def all_queries() -> dict:
    return dict(QUERIES)


from . import queries_rules  # noqa: E402,F401  (registers rule queries)
from . import queries_flows  # noqa: E402,F401
from . import queries_metrics  # noqa: E402,F401
