"""Registry of the queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """The views and tables of a scale factor's folder, by name."""

    spark: SparkSession
    sf_dir: str

    def __call__(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small inline table."""
        return self.spark.createDataFrame(rows, schema)


def query(key: str, rows: str, sql: str | None = None):
    """Register a function of Tables as a query that covers inventory rows, with SQL over the views in braces."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ROWS[key] = rows
        if sql:
            ORACLES[key] = fixtures.twin(sql)
        return f

    return add


def listed(column: str):
    """A comma-separated text as an array; empty text as an empty one."""
    return F.filter(F.split(column, ","), lambda x: F.length(x) > 0)


from siltworks.plans import detect, engine, matching, state, streams, suspects, values  # noqa: E402,F401
