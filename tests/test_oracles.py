"""Every query against its oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare
from conftest import SMALL
from oracles import catalog as oracle_catalog
from riskweave.plans import catalog


@pytest.mark.parametrize("key", sorted(catalog.queries()))
def test_query_equals_oracle(spark, duck, key):
    equal, _, difference = compare(spark, duck, SMALL, key)
    assert equal, difference


def test_entry(spark):
    assert entry.entry(spark).count() > 100


def test_every_query_has_an_oracle():
    assert set(oracle_catalog.oracle_sql()) == set(catalog.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
