import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from contentspark.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "contentspark-tests", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
        spark__sql__streaming__stateStore__providerClass=
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def one(spark):
    """Value of one column expression over one row."""
    def evaluate(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1)
        for name, value in values.items():
            row = row.withColumn(name, value if hasattr(value, "_jc") else F.lit(value))
        return row.select(column.alias("x")).first()["x"]

    return evaluate
