import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from siltworks.llm import queries

TABLES = "documents embeddings benchmark labels conversations".split()
AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    want = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, AT).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    out = corpus_pipeline.run(spark, AT)
    assert out.columns == [*docs.columns, "shard"]
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert 0 < len(kept) < docs.count() and kept <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3


def test_pipeline_stages_on_odd_rows(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, AT)
            rows.count()
            assert rows.columns[:5] == docs.columns, name
