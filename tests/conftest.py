import pytest

from bazarlytics.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a frame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
