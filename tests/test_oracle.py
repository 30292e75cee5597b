"""Every registered query against its SQL, at the scale of the driver's check."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from demandweave.checks import queries as core

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


def test_every_query_has_sql():
    assert set(core.queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    assert compare.difference(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) == ""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
