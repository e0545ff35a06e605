import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pairlab.session import build_session, release

    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from pairlab.plans.derived import Tables

    return Tables(spark, SF)


@pytest.fixture(scope="session")
def matches(spark, tables):
    """Three divisions of the smallest data set, stored once."""
    from pairlab.session import durable

    return durable(tables.canonical.where("Division IN ('N00', 'N01', 'N02')"))
