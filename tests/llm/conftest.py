import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text, lang, source) rows."""

    def of(rows):
        return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], SCHEMA)

    return of


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, "the cat sat on the mat and the dog lay by the door", "en", "a"),
        (1, "the cat sat on the mat and the dog lay by the door", "en", "a"),
        (2, "the cat sat on the mat and the dog lay by the door", None, None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (None, "another text of some words", "fr", None),
        (None, None, None, None),
        (5, "word " * 50_000, "en", "b"),
        (6, "\n\t  \n", "de", "c"),
    ]
    names = "_id _key _row _h _fp fp key node score held_out predicted size copies slot shard_ _slot root cell a b y x h spans"
    out = make(rows)
    for n in names.split():
        out = out.withColumn(n, F.lit("clash"))
    return out
