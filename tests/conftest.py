from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from campusflow.session import get_spark

    session = get_spark(
        app="campusflow-tests",
        master="local[4]",
        shuffle_partitions=4,
        extra={"spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="cf-wh-")},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tools.check_oracle import duck

    return duck(SMALL)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="cf-test-")
