import pytest

from ionloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, memory="4g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
