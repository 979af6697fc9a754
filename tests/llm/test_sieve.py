import pytest
from pyspark.sql import functions as F

from siltworks.llm import common, simhash


@pytest.mark.parametrize("bits", [common.MOST_BITS, 1 << 15])
def test_rows_without_keys_are_told_apart(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FEW", 10)
    monkeypatch.setattr(common, "MOST_BITS", bits)
    rows = spark.range(20_000).select(common.row_key("id").alias("key"), "id")
    keys = common.stored(rows.where("id % 10 = 3").select("key"))
    stay, ask = common.sieve(rows, keys, "key")
    assert stay.count() + ask.count() == 20_000 and stay.where("id % 10 = 3").count() == 0
    assert bits < 1 << 16 or ask.count() < 4_000
    want = [k for k in range(20_000) if k % 10 != 3]
    assert sorted(r.id for r in common.without(rows, keys, "key").collect()) == want
    assert sorted(r.id for r in common.without(rows, keys.limit(0), "key").collect()) == list(range(20_000))


def test_texts_that_stay_are_not_dealt_out(spark, monkeypatch):
    """Only rows that may be copies meet the join that drops them; a null id, a null text and equal rows as before."""
    monkeypatch.setattr(common, "FEW", 10)
    docs = spark.range(3_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("w"), F.when(F.col("id") < 2_900, F.col("id")).otherwise(F.col("id") % 50)).alias("text"),
    )
    docs = docs.union(spark.createDataFrame([(None, "x y"), (7, None), (7, None)], "doc_id long, text string"))
    kept = simhash.one_of_each(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "bitmap" in plan or "_map" in plan
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and (None, "x y") in got and (7, None) in got
    assert max(d for d, _ in got if d is not None) < 2_900


def test_the_sieve_makes_no_rows_and_hashes_a_key_once(spark, monkeypatch):
    """A row's bit is looked up where the row is, not by a join; many equal keys leave most of the bits empty."""
    monkeypatch.setattr(common, "FEW", 10)
    rows = spark.range(5_000).select(common.row_key("id").alias("key"), "id")
    rows = rows.union(spark.createDataFrame([(None, -1), (None, -2)], "key binary, id long"))
    keys = common.stored(spark.range(9_000).select(common.row_key((F.col("id") * 0 + 3).cast("long")).alias("key")))
    stay, ask = common.sieve(rows, keys, "key")
    for part in (stay, ask):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("md5") == 1
    assert stay.count() + ask.count() == 5_002 and ask.where("id = 3").count() == 1 and ask.count() < 100
    want = [k for k in range(-2, 5_000) if k != 3]
    assert sorted(r.id for r in common.without(rows, keys, "key").collect()) == want
