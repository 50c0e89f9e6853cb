"""Queries of the subpackage that SQL can express."""

import pytest

from pairlane import llm
from tests.helpers import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, duck, name):
    same(llm.queries()[name], llm.oracle_sql()[name], spark, SF, duck)
