import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").appName("logquarry-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_lines(spark):
    def make(files, pipeline="rules"):
        rows = [(name, name, pipeline, i + 1, line) for name, body in files.items() for i, line in enumerate(body)]
        schema = "file_path string, module string, pipeline string, line_no long, line string"
        df = spark.createDataFrame(rows, schema)
        return df.selectExpr("file_path", "module", "pipeline", "timestamp '2024-01-01 00:00:00' AS mtime", "line_no", "line")

    return make


@pytest.fixture
def make_bodies(spark):
    def make(files, pipeline="rules"):
        rows = [(name, name, pipeline, list(body)) for name, body in files.items()]
        df = spark.createDataFrame(rows, "file_path string, module string, pipeline string, body array<string>")
        return df.selectExpr("file_path", "module", "pipeline", "timestamp '2024-01-01 00:00:00' AS mtime", "body")

    return make
