import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=[None, 3], ids=["whole", "blocks-of-3"])
def blocks(request, spark):
    """Run a test with whole episodes and with blocks of three rows."""
    if request.param:
        spark.conf.set("spark.trajlake.block.rows", str(request.param))
        spark.conf.set("spark.trajlake.split.rows", str(request.param))
    yield request.param
    spark.conf.unset("spark.trajlake.block.rows")
    spark.conf.unset("spark.trajlake.split.rows")
