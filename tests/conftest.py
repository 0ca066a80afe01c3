import os
import sys
import tempfile

import pytest

_TESTS = os.path.dirname(os.path.abspath(__file__))
_REPO = os.path.dirname(_TESTS)
sys.path.insert(0, _REPO)
# Python workers inherit this: they can import the package and helpers defined in tests.
os.environ["PYTHONPATH"] = os.pathsep.join([_REPO, _TESTS, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from corpuslab.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8,
                      extra={"spark.driver.memory": "4g", "spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="corpuslab-test-")
