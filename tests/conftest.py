import pytest

from graphloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
