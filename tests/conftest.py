import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").appName("lodestat-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A table of double columns of possibly unequal length."""

    def make(**columns):
        rows = max((len(v) for v in columns.values()), default=0)
        data = [tuple(float(v[i]) if i < len(v) and v[i] is not None else None for v in columns.values()) for i in range(rows)]
        return spark.createDataFrame(data, ", ".join(f"{c} double" for c in columns))

    return make
