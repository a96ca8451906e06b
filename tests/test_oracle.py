"""Every query against its SQL."""

import pytest
from conftest import SF_DIR, rows_of

from textmill.plans.oracle import ORACLE_SQL
from textmill.plans.queries import QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry_points(spark):
    import __spark_entry__ as entry

    frame = entry.entry(spark)
    assert frame.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
