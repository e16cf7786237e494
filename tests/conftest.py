"""Shared Spark session (local, UTC, its own checkpoint folder) and the seed fixture."""

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from subsight.session import build_session

    s = build_session("local[4]", app="subsight-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="subsight-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from subsight.sources.seed import seed_tables

    return seed_tables(spark, SEED_AS_OF)


SEED_AS_OF = "2025-06-01 12:00:00"
