from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from voltframe.session import get_session

    s = get_session("local[*]", app_name="voltframe-tests", shuffle_partitions=8)
    yield s
    s.stop()
