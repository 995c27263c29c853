"""Every registered query on the smallest tables, beside its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import differences, oracle

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, connection, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in SQL:
        assert differences(got, connection.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_every_oracle_belongs_to_a_query():
    assert SQL.keys() <= entry.queries().keys()
