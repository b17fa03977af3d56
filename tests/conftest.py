import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.log.level": "ERROR"},
    )
    yield session
    session.stop()


@pytest.fixture
def many_slices(monkeypatch):
    """Cut even tiny tables into many slices, so that every carry and halo path runs."""
    from gridloom.operators import timeorder

    monkeypatch.setattr(timeorder, "ROWS_PER_SLICE", 40)
    monkeypatch.setattr(timeorder, "_SMALL_SLICE", 5)
