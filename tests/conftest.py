import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cueloom.plans.blocks import WHOLE_ROWS  # noqa: E402
from cueloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def blocks(spark):
    """Force the block path, whatever the size of the table."""
    spark.conf.set(WHOLE_ROWS, "0")
    yield
    spark.conf.unset(WHOLE_ROWS)


@pytest.fixture(params=["whole", "blocks"])
def either(request, spark):
    """Run a test with whole keys and again with keys cut into blocks."""
    if request.param == "blocks":
        spark.conf.set(WHOLE_ROWS, "0")
    yield request.param
    spark.conf.unset(WHOLE_ROWS)
