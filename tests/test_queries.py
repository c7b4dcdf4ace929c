"""Every query of the library that has SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyloom import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLES:
        return
    want = duck.sql(plans.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    theirs = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    key = lambda r: tuple(str(plain(v)) for v in r)
    assert sorted(key(r) for r in theirs) == sorted(key([r[c] for c in columns]) for r in rows)
