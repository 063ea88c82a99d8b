import pytest

from tidelog import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tidelog-tests", master="local[8]", shuffle_partitions=3)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
