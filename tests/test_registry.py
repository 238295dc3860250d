import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from sigwarn import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cur = duck.execute(registry.ORACLES[name])
    theirs = [x[0] for x in cur.description]
    assert sorted(theirs) == cols
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    want = sorted((tuple(norm(r[theirs.index(c)]) for c in cols) for r in cur.fetchall()), key=key)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
