"""Corpus preparation in five stages, each an operator of siltworks.llm over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltworks.llm import common, decontaminate, mixing, nearcopies, sharding, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: by fingerprints first, then by shingles of five words."""
    return nearcopies.one_of_each(common.stored(simhash.one_of_each(docs)))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each goes to."""
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: A learnt classifier and components of hashes are among the stages, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again before the next.

    What a stage stored on the way goes when its result is written, and that when the next one's is.
    """
    docs = _table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with common.scratch(spark) as keep:
            after = keep(common.stored(stage(spark, docs, sf_dir)))
        if number:
            common.drop_stored(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
