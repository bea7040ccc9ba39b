"""Every query of the filing library that has SQL gives the rows of its SQL; the others run."""

import pytest

from quarry import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_agrees_with_sql(agree, name):
    agree(name)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
