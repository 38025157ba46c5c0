"""Every registered query with SQL against DuckDB on the smallest tables; the others run."""

import pytest

from textward.plans import catalog
from tests.helpers import rows_of, sql_rows

SF = "/root/testdata/sf0.001"
#: Nothing in the tables is of their kind; tests of their own have rows for them.
NONE = {"d9_unicode_tags"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, name):
    assert rows_of(catalog.QUERIES[name](spark, SF)) == sql_rows(catalog.ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    assert len(set(found.columns)) == len(found.columns) and (found.count() > 0) == (name not in NONE)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
