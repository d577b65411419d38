import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from assayer.session import local_session
    s = local_session(8)
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture(scope="session")
def data():
    return DATA
