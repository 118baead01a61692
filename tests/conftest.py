import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sightline import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
                      spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
