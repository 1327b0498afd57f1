import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from meterbook.session import local_session

    session = local_session("meterbook-tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dim(spark):
    from meterbook.operators.pricing import build_dim_price

    return build_dim_price(spark)
