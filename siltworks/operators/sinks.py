"""Upserts on tables without in-place updates: a snapshot and changes in, the next snapshot out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows: those of an equal key replaced, column by column where new has a value."""
    a, b = old.alias("a"), new.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    columns = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    pick = lambda c: [F.col(f"{t}.{c}") for t, d in (("b", new), ("a", old)) if c in d.columns]
    return a.join(b, on, "full_outer").select(*(F.coalesce(*pick(c)).alias(c) for c in columns))


def inserted_if_absent(old: DataFrame, new: DataFrame, key: list[str], fold_case: bool = False) -> DataFrame:
    """old and those of new's rows whose key old lacks; of new rows with one key, the first by all columns."""
    low = lambda d: [F.lower(d[k]) if fold_case else d[k] for k in key]
    first = new.groupBy(*(e.alias(f"_k{i}") for i, e in enumerate(low(new)))).agg(
        F.min(F.struct(*new.columns)).alias("_r")
    )
    known = old.select(*(e.alias(f"_k{i}") for i, e in enumerate(low(old)))).distinct()
    fresh = first.join(known, [f"_k{i}" for i in range(len(key))], "left_anti").select("_r.*")
    return old.unionByName(fresh, allowMissingColumns=True)


def replaced_set(old: DataFrame, current: DataFrame, scope: list[str]) -> DataFrame:
    """old with all rows of each scope that current has replaced by current's."""
    return old.join(current.select(*scope).distinct(), scope, "left_anti").unionByName(current)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
