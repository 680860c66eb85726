import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sentimill.session import local_session

    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """A frame of text lines."""

    def make(*values):
        return spark.createDataFrame([(v,) for v in values], "value string")

    return make
