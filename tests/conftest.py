import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from netflow_spark.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", shuffle_partitions=4, app="netflow_spark_tests")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def frame(spark, rows, schema=None):
    """DataFrame from dict rows; adds frame_number in list order when absent."""
    import pandas as pd
    pdf = pd.DataFrame(rows)
    if "frame_number" not in pdf.columns:
        pdf.insert(0, "frame_number", range(1, len(pdf) + 1))
    pdf = pdf.astype(object).where(pdf.notna(), None)
    return spark.createDataFrame(pdf, schema=schema) if schema else spark.createDataFrame(pdf)
