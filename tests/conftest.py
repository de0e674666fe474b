import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, HERE)
# Python workers import the package too, wherever the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (HERE, os.environ.get("PYTHONPATH", ""))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column function over Python values, in order."""
    from pyspark.sql import functions as F

    def run(fn, items, kind="string"):
        rows = [(i, v) for i, v in enumerate(items)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]

    return run
