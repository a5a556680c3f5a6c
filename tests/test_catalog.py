"""Every query against its SQL on DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from regioprofile.plans import catalog

SF = "/root/testdata/sf0.001"
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, key):
    df = catalog.QUERIES[key](spark, SF)
    r = duck.execute(catalog.ORACLES[key])
    columns = [c[0] for c in r.description]
    assert {c: KINDS[k] for c, k in df.dtypes} == {c[0]: str(c[1]) for c in r.description}
    want = sorted(repr([plain(row[columns.index(c)]) for c in sorted(columns)]) for row in r.fetchall())
    got = sorted(repr([plain(row[c]) for c in sorted(columns)]) for row in df.collect())
    assert got == want and got
