from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shoplens.session import build_session  # noqa: E402
from shoplens.sources.stages import StageStore  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", 4, **{"spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    return StageStore(spark, str(tmp_path / "stages"))
