import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from trustlens import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()
