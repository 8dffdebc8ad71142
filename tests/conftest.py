import pytest

from tests.oracle import make_session


@pytest.fixture(scope="session")
def spark():
    return make_session()
