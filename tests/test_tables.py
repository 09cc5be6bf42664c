"""Every query over the tables against its SQL."""

import glob
import os

import duckdb
import pytest

from quarry.plans import tables
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(str, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(tables.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert rows(tables.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(tables.ORACLES[name]).df())


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(tables.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "path"
