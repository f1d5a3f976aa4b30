"""Every query of the engine's own operators, held against its SQL."""

import compare
import pytest

from lectern.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert compare.compare(spark, SF, name) == ""
