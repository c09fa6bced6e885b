"""Every registered query against its SQL twin on whole tables."""

import pytest

from citesift.registry import ORACLE, QUERIES
from oracle import difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), ORACLE[name], SF_DIR) is None


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
