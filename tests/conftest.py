import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from matchloom import session

    s = session.get_session("tests", cores="8", shuffle_partitions=8, driver_memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    return s
