import pytest

from thermobox.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="thermobox-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
