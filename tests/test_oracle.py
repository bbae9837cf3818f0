"""Every core query with an SQL twin gives the rows of the twin; the others give rows."""

import oracle
import pytest

import __spark_entry__ as entry
from velkora.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_rows(spark, con, name):
    names, want, _ = oracle.rows_of_sql(con, core.ORACLE[name])
    got_names, got, _ = oracle.rows_of_spark(core.QUERIES[name](spark, SF))
    assert got_names == names
    assert got == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0  # their rows are compared in test_brute.py


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
