"""The corpus queries against their SQL."""

import pytest

from glossa.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(name, agree):
    agree(Q.QUERIES[name], Q.SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
