import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(__file__)), os.path.dirname(__file__)]


@pytest.fixture(scope="session")
def spark():
    from concord.session import local_session

    session = local_session("concord-tests", "8", 2, **{"spark.default.parallelism": "2"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def interpreted(spark):
    """Tiny inputs: skip compiling a stage per query. The query tests cover generated code."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
