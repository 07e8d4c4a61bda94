from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from matchloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    place = tempfile.mkdtemp(prefix="spark-")
    s = session("tests", "local[4]", spark__sql__shuffle__partitions=4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=f"{place}/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(place)
    yield s
    s.stop()
