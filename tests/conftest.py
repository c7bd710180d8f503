import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "false")
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.sql.codegen.factoryMode", "NO_CODEGEN")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_units(monkeypatch):
    """Keys count as hot from three rows on, so that shards and salts are used on small inputs."""
    import causeway.skew

    monkeypatch.setattr(causeway.skew, "unit_rows", lambda total, floor=0: 3)


@pytest.fixture
def small_ranges(small_units, monkeypatch):
    """The same, with more units than may be broadcast, so that tables are cut by ranges."""
    import causeway.skew

    monkeypatch.setattr(causeway.skew, "MAX_CUTS", 4)
