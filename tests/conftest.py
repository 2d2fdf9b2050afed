import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from keyroll.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()
