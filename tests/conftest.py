import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = oracle.make_spark()
    session.sparkContext.setLogLevel("ERROR")
    return session
