"""Every registered study query, and its SQL where there is one."""

import pytest
from locusloom.plans import dataset_queries, file_queries  # noqa: F401
from locusloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck, same):
    found = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        assert len(found)
        same(found, duck.sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
