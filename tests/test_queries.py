"""Every registered query against its SQL, on the smallest tables."""

import os

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, SF)
    got = compare.spark_rows(frame)
    if name in SQL:
        assert compare.difference(got, compare.sql_rows(db, SQL[name])) == ""
    else:
        assert got[0] == sorted(frame.columns)
