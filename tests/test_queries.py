"""Every registered query of the engine's own operators against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from tidewell.plans import bundled, driver, frames

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 6) if isinstance(x, float) else str(x).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query(spark, duck, name):
    assert bundled and frames
    df = driver.QUERIES[name](spark, SF)
    got = [tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in driver.SQL:
        assert got
        return
    found = duck.execute(driver.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(value(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()]
    assert sorted(got, key=str) == sorted(want, key=str)
