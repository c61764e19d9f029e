"""Every registered query against its SQL on the smallest tables."""

import pytest

from catalog import QUERIES, SQL
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    text, _, ok = compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir)
    assert ok, text


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
