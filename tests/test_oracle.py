"""Every registered query against its SQL on the smallest tables."""

import pytest

from verification import compare
from verification.oracle_queries import ORACLE
from verification.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare.differences(QUERIES[name](spark, FOLDER), duck, ORACLE[name]) == []
