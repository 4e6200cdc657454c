"""Every query against its SQL, over whole tables."""

import pytest

from quarry import queries
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        same(spark, DATA, queries.QUERIES[name], queries.SQL[name])
    else:
        assert queries.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(queries.QUERIES) <= set(e.queries())


def test_a_headline_crawl_reaches_every_page(spark):
    import bench

    name = next(n for n in bench.HEADLINE if n.startswith("bfs_"))
    every = spark.read.parquet(f"{DATA}/customer.parquet").count()
    assert queries.QUERIES[name](spark, DATA).count() == every > 127
