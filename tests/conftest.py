import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from citadine import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    out = session.local(4, "4g", f"file://{tmp_path_factory.mktemp('shared')}")
    yield out


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
