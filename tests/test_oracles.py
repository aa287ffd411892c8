"""Every registered query against its SQL on the same parquet files."""

import pytest
from check import compare, duck

from lagoon.registry import entries, run

ENTRIES = entries()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(name, spark, small, con):
    text, same = compare(run(name, spark, small), con, ENTRIES[name].sql)
    assert same, text
