from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import local_session

    s = local_session(4, shuffle_partitions=4, **{"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    # tests run in local mode: set a checkpoint folder only because none is set
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shelfwise-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small() -> str:
    if not os.path.exists(f"{SF_SMALL}/lineitem.parquet"):
        pytest.skip("test data not present")
    return SF_SMALL
