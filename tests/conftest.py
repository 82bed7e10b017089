from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from weft.session import local_session

    session = local_session(4, "4g", "weft-tests")
    yield session
    session.stop()
