import pytest

from lodestream import catalogue
from tests import oracle

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalogue.oracles())


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_oracle_has_a_query():
    assert set(catalogue.oracles()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_against_oracle(spark, con, name):
    oracle.same(catalogue.queries()[name](spark, SF), con, catalogue.oracles()[name])
