import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandwork.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, 4)
    yield session
    session.stop()
