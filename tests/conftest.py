import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from formbook.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(os.environ.get("TEST_CPUS", "8"), app="formbook-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


def rows(df, *order):
    """Collected rows as tuples, sorted by the given columns (all when none)."""
    keys = order or df.columns
    found = [r.asDict() for r in df.collect()]
    found.sort(key=lambda r: tuple((r[k] is None, r[k]) for k in keys))
    return [tuple(r[c] for c in df.columns) for r in found]
