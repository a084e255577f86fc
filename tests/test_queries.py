"""Every registered query of the engine against its SQL."""

import pytest
from oracle import assert_same

from tidemark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name], SF)
