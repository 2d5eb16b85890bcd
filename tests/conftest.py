import pytest

from sensorloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[2]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
