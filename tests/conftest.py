import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lendscope.session import local_session

    s = local_session("*", 8)
    yield s


@pytest.fixture(scope="session")
def duck01():
    from oracle_compare import duck_for

    return duck_for(SF01)


@pytest.fixture(scope="session")
def duck001():
    from oracle_compare import duck_for

    return duck_for(SF001)
