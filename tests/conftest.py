import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runwarden.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[*]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def hot(monkeypatch):
    """Cut every key into many chunks."""
    from runwarden.operators import ordering

    monkeypatch.setattr(ordering, "TIME_STEP", 1)
    monkeypatch.setattr(ordering, "COUNT_STEP", 2)
    monkeypatch.setattr(ordering, "STEPS_PER_DOUBLING", 64)
