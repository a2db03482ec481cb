"""Grid queries against DuckDB; the slowest are left to the driver's own comparison."""

import pytest

from gridloom.plans import catalog
from tests.duck import connect, same

NAMES = [n for n in catalog.oracle_sql() if n not in ("ledger_resolve",)]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, sf_dir, con):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    assert same(got, con.sql(catalog.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
