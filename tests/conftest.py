import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TESTS_DIR = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
sys.path.insert(0, TESTS_DIR)


@pytest.fixture(scope="session")
def spark():
    from staytrail.session import get_session
    s = get_session("local[4]", 4, extra={"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


def ts(text: str | None):
    if text is None:
        return None
    fmt = "%Y-%m-%d %H:%M:%S" if len(text) > 16 else ("%Y-%m-%d %H:%M" if len(text) > 10 else "%Y-%m-%d")
    return datetime.strptime(text, fmt)
