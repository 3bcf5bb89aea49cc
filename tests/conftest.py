import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF = os.environ.get("KINMATCH_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kinmatch.session import local_session

    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session(4, shuffle_partitions=4, spark__checkpoint__dir=str(folder))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
