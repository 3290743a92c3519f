import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from armlift.session import build_session

    s = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    """Build a DataFrame of (segment, grp, y[, x]) from arrays."""
    import pandas as pd

    def build(**columns):
        return spark.createDataFrame(pd.DataFrame(columns))

    return build
