import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from examlytics.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="examlytics-tests")
    yield s
    s.stop()


def col_values(spark, values, fn, name="x"):
    """Apply a Column function to a list of strings; return results in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.select(fn(F.col(name)), "i").orderBy("i").collect()]
