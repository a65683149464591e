"""Every registered query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from millrace import register


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in os.listdir(data):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{data}/{t}'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("name", register.QUERIES)
def test_query(spark, data, db, name):
    df = register.QUERIES[name](spark, data)
    got = sorted(sorted((c, plain(r[c])) for c in df.columns) for r in df.collect())
    if name in register.SQL:
        out = db.sql(register.SQL[name])
        names = out.columns
        assert got == sorted(sorted((c, plain(v)) for c, v in zip(names, row)) for row in out.fetchall())
    else:
        assert got
