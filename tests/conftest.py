from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tillcast.session import get_spark

    s = get_spark("local[*]", 8, app_name="tillcast-tests")
    yield s
    s.stop()
