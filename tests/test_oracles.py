"""Every registered query against its SQL oracle on the smallest tables."""

import math

import duckdb
import pytest

from urbanspark import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    if name not in registry.ORACLES:
        assert rows
        return
    cursor = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = ordered([tuple(plain(r[i]) for i in at) for r in cursor.fetchall()])
    assert len(rows) == len(expected)
    for got, want in zip(rows, expected, strict=True):
        for a, b in zip(got, want, strict=True):
            assert a == b or (isinstance(a, float) and a == pytest.approx(float(b), rel=1e-6, abs=1e-4)), (got, want)
