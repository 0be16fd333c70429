import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from kgspark.session import session

    own = session(4, 4, spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    own.sparkContext.setLogLevel("ERROR")
    yield own


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
