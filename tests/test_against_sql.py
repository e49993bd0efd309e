"""Every registered query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from folium.plans import ORACLE, QUERIES

DATA = os.environ.get("FOLIUM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def cells(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.6g}"
        return str(v)

    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, db, name):
    frame = QUERIES[name](spark, DATA)
    want = db.sql(ORACLE[name])
    assert sorted(frame.columns) == sorted(want.columns)
    assert cells(frame.columns, frame.collect()) == cells(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert frame.columns and frame.count() >= 0
