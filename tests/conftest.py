"""One Spark session for all tests."""

from __future__ import annotations

import os

import pytest

from auditlake import build_session

SF = os.environ.get("TEST_SF", "0.01")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", 8, {"spark.driver.memory": "8g", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"/root/testdata/sf{SF}"


@pytest.fixture
def frame(spark):
    """``frame(schema, rows)`` as a DataFrame."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
