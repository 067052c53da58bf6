"""One Spark session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from loanloom.session import local_session

    session = local_session("8", "loanloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture(scope="session")
def tables(spark, folder):
    from loanloom.sources.star import StarTables

    return StarTables(spark, folder)


@pytest.fixture(scope="session")
def sql_engine(folder):
    import check_results

    return check_results.connect(folder)
