import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from shelfmark.runtime import build_session

    session = build_session("tests", cores=4, shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"
