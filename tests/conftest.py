"""One local session for all tests; Python workers find the repository by PYTHONPATH."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import local_session

    s = local_session("tests", cpus=4, memory="3g")
    yield s
    s.stop()
