"""Every analysis with SQL equals it on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


# every column of the frame matched on donors in turn takes minutes; test_imputation_sources.py has smaller chains
LONG = {"donors_of_whole_frame"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - LONG))
def test_equal(spark, folder, con, name):
    assert compare.difference(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 7
