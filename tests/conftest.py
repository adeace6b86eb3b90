import pytest

from graphloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores=4, spark__driver__memory="4g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    return session
