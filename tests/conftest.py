import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parents[1] / "tools")]


@pytest.fixture(scope="session")
def spark():
    from lectern.session import session

    return session(4, memory="4g")
