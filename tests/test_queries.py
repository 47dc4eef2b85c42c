"""Every query of the core engine against its SQL on the smallest tables."""

import pytest

from lexforge.plans import all as _all  # noqa: F401
from lexforge.plans import registry
from tests.compare import connect, difference


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    assert difference(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name], duck) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_partitions_do_not_change_the_ranking(spark, sf_dir):
    once = sorted(map(tuple, registry.QUERIES["bm25_topk"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = sorted(map(tuple, registry.QUERIES["bm25_topk"](spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert once == again


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
