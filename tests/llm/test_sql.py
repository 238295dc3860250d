import duckdb
import pytest

import __spark_entry__ as entry
from sigwarn import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - set(registry.ORACLES)))
def test_corpus_query_equals_sql(spark, name, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = duck.execute(entry.oracle_sql()[name])
    theirs = [x[0] for x in cur.description]
    assert sorted(theirs) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in theirs) for r in df.collect()), key=str) == sorted(cur.fetchall(), key=str)
