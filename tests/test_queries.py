"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import math
import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from tarnwell import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def text(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return v.isoformat() if isinstance(v, datetime) else str(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF_DIR)
    order = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*order).collect())
    found = con.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == order
    expected = sorted(tuple(map(text, r)) for r in found.select(*[f'"{c}"' for c in order]).fetchall())
    assert got == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
