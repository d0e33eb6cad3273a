"""One session for all tests."""

import os

import pytest

from trajecta.session import get_session, ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TRAJECTA_DRIVER_MEMORY", "4g")
    s = get_session("tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("OFF")
    yield ship(s)


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF
