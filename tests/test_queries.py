"""Every registered query against its SQL statement, on the smallest data."""

import glob
import os
from datetime import date, datetime

import pytest

from tallyweir.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables absent")

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    found = df.collect()
    if name not in ORACLES:
        assert found
        return
    stated = db.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(stated.columns)
    kinds = dict(df.dtypes)
    assert {c: TYPES[kinds[c]] for c in columns} == {
        c: str(t) for c, t in zip(stated.columns, stated.types)
    }
    expected = [tuple(row[stated.columns.index(c)] for c in columns) for row in stated.fetchall()]
    assert _ordered(tuple(row[c] for c in columns) for row in found) == _ordered(expected)
    assert all(not isinstance(v, datetime) or v.tzinfo is None for row in found for v in row)
    assert all(isinstance(v, date | str | int | float | bool | None) for row in found for v in row)
