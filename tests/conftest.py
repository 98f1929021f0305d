import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from factloom import session

    s = session.build(master="local[4]", partitions=4, **{"spark__driver__memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
