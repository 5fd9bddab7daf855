import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["TZ"] = "UTC"

from plexora.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("4", "plexora-tests", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
