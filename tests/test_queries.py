"""Every registered ledger query against its SQL, on the smallest tables."""

import pytest

from tallyforge.plans import catalog
from tests.oracle import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, DATA, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
