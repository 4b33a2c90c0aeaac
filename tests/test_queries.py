"""Every query of the library gives the rows of its SQL; those without SQL give some rows."""

from __future__ import annotations

import pytest

from sonagrid.plans import catalog
from tests.compare import assert_same, connection
from tests.conftest import SMALL

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    if name in SQL:
        assert_same(df, duck, SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
