import pytest

from albumloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session(memory="8g")
