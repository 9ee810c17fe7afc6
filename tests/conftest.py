import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from countylens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
              "spark.sql.maxMetadataStringLength": "10000"}
    session = local_session("4", "tests", "4g", shared)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """The value of a column expression, given literals."""
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]
    return value


@pytest.fixture(scope="session")
def plan(spark):
    """The physical plan as text."""
    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()
    return text
