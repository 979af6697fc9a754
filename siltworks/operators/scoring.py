"""Risk scores: decayed points of detections, and what a repository and its operator add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import constants as K

DECAY = 0.6


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def severity(score: Column) -> Column:
    out = F.lit(K.LOWEST_SEVERITY)
    for least, name in reversed(K.SEVERITY_BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def threat_classes(categories: Column) -> Column:
    """credential_exposure, malicious_intent, both, or other."""
    has = lambda names: F.coalesce(
        F.arrays_overlap(categories, F.array(*map(F.lit, names))), F.lit(False)
    )
    some = F.array_compact(
        F.array(
            F.when(has(K.CREDENTIAL_CATEGORIES), F.lit("credential_exposure")),
            F.when(has(K.INTENT_CATEGORIES), F.lit("malicious_intent")),
        )
    )
    return F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("other")))


def points(detections: DataFrame, by: str) -> DataFrame:
    """detections with `points`: the raw worth of each, less the more often its rule has fired stronger."""
    raw = F.col("risk_contribution") * (0.5 + F.col("confidence") * 0.5)
    rank = F.row_number().over(Window.partitionBy(by, "rule_id").orderBy(F.desc("raw"), "ord")) - 1
    rows = detections.withColumn("raw", raw).withColumn("rank", rank)
    return rows.withColumn("points", half_up(F.col("raw") * F.pow(F.lit(DECAY), F.col("rank"))).cast("long"))


def scores(
    detections: DataFrame,
    repos: DataFrame,
    by: str,
    as_of: Column,
    operators: DataFrame | None = None,
) -> DataFrame:
    """Rows (by, score, severity, categories, breakdown) of detections and of one row of repos for each `by`.

    repos has stars, forks and created_at; operators, if given, other_brands and linked_owners.
    The breakdown is an array of (ord, factor, points): the detections', then what was added.
    """
    worth = points(detections, by).withColumn("factor", F.coalesce("rule_name", "rule_id"))
    sums = worth.groupBy(by).agg(
        F.sum("points").alias("base"), F.array_sort(F.collect_set("category")).alias("categories"), F.count("*").alias("detections"),
        F.array_sort(F.collect_list(F.struct("ord", "factor", "points"))).alias("items"),
    )
    rows = sums.join(repos, by, "left")
    if operators is not None:
        rows = rows.join(operators, by, "left")
    else:
        rows = rows.withColumns({"other_brands": F.lit(0), "linked_owners": F.lit(0)})
    intent = F.arrays_overlap("categories", F.array(*map(F.lit, K.INTENT_CATEGORIES)))
    stars, forks = F.coalesce("stars", F.lit(0)), F.coalesce("forks", F.lit(0))
    organic = (stars > 0) & (forks / F.when(stars > 0, stars) >= 0.02)
    age = (
        F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    ) / 86_400_000_000
    n = F.size("categories")
    added = (
        ("Multiple threat categories", F.when(n >= 3, 10).when(n == 2, 5)),
        ("High repository reputation", F.when(intent & (stars >= 1000) & organic, -12)),
        ("Possibly inflated stars", F.when(intent & (stars >= 1000) & ~organic, 6)),
        ("Very low popularity", F.when(intent & (stars <= 1), 6)),
        ("Very new repository", F.when(intent & (age <= 14), 8)),
        ("Repeat operator pattern", F.when(F.col("other_brands") > 0, F.least(F.lit(20), 8 + F.col("other_brands") * 6))),
        ("Linked to other identities", F.when(F.col("linked_owners") > 0, F.least(F.lit(30), 15 + F.col("linked_owners") * 8))),
    )
    extra = F.array_compact(F.array(*(
        F.when(p.isNotNull(), F.struct((F.lit(1 << 60) + k).cast("long").alias("ord"), F.lit(name).alias("factor"), p.cast("long").alias("points"))) for k, (name, p) in enumerate(added)
    )))
    items = F.concat(
        F.transform(
            "items",
            lambda i: F.struct(
                i["ord"].cast("long").alias("ord"), i["factor"].alias("factor"), i["points"].alias("points")
            ),
        ),
        extra,
    )
    total = F.aggregate(items, F.lit(0).cast("long"), lambda s, i: s + i["points"])
    score = F.greatest(F.lit(0), F.least(F.lit(100), total))
    out = rows.select(by, score.cast("long").alias("score"), "categories", items.alias("breakdown"))
    return out.withColumn("severity", severity(F.col("score")))
