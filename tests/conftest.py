import pytest

from structlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[4]", shuffle_partitions=4, app="structlens-tests", spark__driver__memory="4g", spark__sql__ui__retainedExecutions="5")
    yield session
    session.stop()
