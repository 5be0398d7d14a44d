import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session

    return local_session(cpus=4, partitions=4, memory="3g", name="tests")
