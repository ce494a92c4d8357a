"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest
from compare import check

import __spark_entry__
from trackloom.plans import problems, registry

QUERIES, ORACLES = registry.QUERIES | problems.QUERIES, registry.ORACLES | problems.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    check(spark, sf, QUERIES[name], ORACLES.get(name))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_contract():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
