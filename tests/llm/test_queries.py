"""The contract queries against their SQL over whole tables."""

import pytest

from quarry.llm import queries
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    same(spark, DATA, queries.QUERIES[name], queries.SQL[name])


def test_registered():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and "pipeline" in e.queries()
