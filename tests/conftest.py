import pytest

from fareflow.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
