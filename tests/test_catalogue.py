"""Every relational query against its SQL."""

import pytest
from oracle import differs

from gneiss.plans import catalogue, source_queries  # noqa: F401 (registers its queries)

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differs(spark, SMALL, catalogue.queries()[name], catalogue.oracle_sql()[name]) is None
