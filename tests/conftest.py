import pytest

from proplytics.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, app="tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("work")))
    yield session
    session.stop()
