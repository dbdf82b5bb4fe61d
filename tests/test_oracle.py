"""Every job with a SQL twin gives the same rows; the others run and give rows."""

import pytest

from lexicue.plans import JOBS
from tests.compare import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job(spark, con, name):
    why = compare(spark, con, name, SMALL)
    assert why in ("", "no rows"), why
