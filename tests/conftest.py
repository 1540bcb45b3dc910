"""One small Spark session for all tests."""

import pytest

from quirespark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, driver_memory="2g", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
