"""Every query of the library against its SQL, over the smallest tables."""

import pytest
from compare import connect, same

from quillspark import catalog

#: Sequential constructs that SQL does not express; they have no test of their own yet.
NO_SQL = {"markdown_blocks", "fixed_texts"}


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


def test_every_query_has_sql_but_two():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == NO_SQL
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, small_dir, name):
    same(con, catalog.QUERIES[name](spark, small_dir), catalog.ORACLES[name])


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
