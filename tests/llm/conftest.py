import os

import pytest

from lurewatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("8")


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("LUREWATCH_TEST_TABLES", "/root/testdata/sf0.001")
