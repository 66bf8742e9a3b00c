import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from textloom.session import build_session

    session = build_session(
        "textloom-tests", "local[4]",
        spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
