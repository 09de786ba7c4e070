import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hindcast.session import configure  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("hindcast-tests")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@pytest.fixture(scope="session")
def spark():
    s = session()
    yield s
    s.stop()


@pytest.fixture
def folder():
    """A new scratch folder per test."""
    return tempfile.mkdtemp(prefix="hindcast-test-")
