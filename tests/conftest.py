from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import get_session
    s = get_session("local[4]", 4, app_name="ledgerline-tests")
    yield s


@pytest.fixture()
def scratch(spark, tmp_path):
    """A fresh folder per test (tests may use a local folder; jobs use the checkpoint dir)."""
    return str(tmp_path)
