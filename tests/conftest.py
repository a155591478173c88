import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def cloud(spark):
    """Make points from rows of numbers: X, Y, Z and further named columns."""

    def make(rows, *names):
        names = names or ("X", "Y", "Z")
        return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "pid long, " + ", ".join(f"{n} double" for n in names))

    return make
