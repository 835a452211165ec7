"""Every registered query against its SQL."""

import pytest

from glossa import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(name, agree):
    assert name in plans.SQL
    agree(plans.QUERIES[name], plans.SQL[name])
