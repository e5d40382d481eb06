"""One local session for all tests, with a checkpoint folder of its own."""

import shutil
import tempfile

import pytest

from tidemill.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="tidemill-tests-")
    session = local_session("tests", 4, **{"spark.checkpoint.dir": folder, "spark.driver.memory": "6g"})
    session.sparkContext.setCheckpointDir(folder)
    yield session
    shutil.rmtree(folder, ignore_errors=True)
