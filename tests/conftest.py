import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from borgata.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", app="tests", spark__sql__shuffle__partitions="2", spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("OFF")
    logging.getLogger("DataFrameQueryContextLogger").disabled = True
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows and a schema text -> DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def apply(spark):
    """Values of one column through an expression."""
    from pyspark.sql import functions as F

    def run(fn, values, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, x {kind}").coalesce(1)
        return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]

    return run


@pytest.fixture
def executed(spark):
    """Text of the executed plan after a full run."""

    def run(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    return run
