import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioworks.plans.session import local_session, reachable  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = reachable(local_session(4, "6g", 4))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
