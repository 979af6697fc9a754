"""Answers of assessment models: parsing, bounds and whether their citations hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.scoring import half_up

INTENTS = ("malicious", "suspicious", "benign", "inconclusive")
DIRECTIONS = ("increases_risk", "decreases_risk", "neutral")
ANSWER = (
    "intent string, riskScore double, confidence double, reasoning string, signalsUsed array<string>, needsDeepReview boolean, "
    "factors array<struct<factor:string,direction:string,evidenceReferences:array<string>>>, missingInformation array<string>"
)


def json_object(text: Column) -> Column:
    """The JSON object of an answer: the whole, what a fence holds, or what is between the outer braces; null if none parses."""
    plain = F.trim(text)
    fenced = F.trim(F.regexp_extract(plain, r"(?is)```(?:json)?\s*(.*?)```", 1))
    braces = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    good = lambda t: F.when(F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), t)
    return F.coalesce(good(plain), good(fenced), good(braces))


def parsed(text: Column) -> Column:
    """Struct of an answer, within bounds and with defaults; null without a JSON object."""
    a = F.from_json(json_object(text), ANSWER)
    none = F.array().cast("array<string>")
    clamp = lambda v, low, high: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(
        F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), v))
    )
    some = lambda v, n: F.slice(F.filter(F.coalesce(v, none), lambda s: s.isNotNull()), 1, n)
    reason = F.trim(a["reasoning"])

    def factor(f: Column) -> Column:
        way = F.when(f["direction"].isin(*DIRECTIONS), f["direction"]).otherwise("neutral")
        return F.struct(
            F.substring(F.trim(f["factor"]), 1, 300).alias("factor"),
            way.alias("direction"),
            some(f["evidenceReferences"], 10).alias("references"),
        )

    factors = F.filter(
        F.transform(F.filter(a["factors"], lambda f: f.isNotNull()), factor), lambda f: F.length(f["factor"]) > 0
    )
    empty = F.array().cast("array<struct<factor:string,direction:string,references:array<string>>>")
    missing = F.filter(
        F.transform(F.coalesce(a["missingInformation"], none), lambda s: F.substring(F.trim(s), 1, 300)),
        lambda s: F.length(s) > 0,
    )
    made = F.struct(
        F.when(a["intent"].isin(*INTENTS), a["intent"]).otherwise("inconclusive").alias("intent"), clamp(a["riskScore"], 0, 100).alias("risk_score"),
        clamp(a["confidence"], 0, 1).alias("confidence"), F.when(F.length(reason) > 0, F.substring(reason, 1, 2000)).otherwise("No reasoning provided by model.").alias("reasoning"),
        some(a["signalsUsed"], 20).alias("signals"), F.coalesce(F.slice(factors, 1, 10), empty).alias("factors"), F.slice(missing, 1, 10).alias("missing"),
        F.coalesce(a["needsDeepReview"], F.lit(False)).alias("needs_deep_review"),
    )
    return F.when(json_object(text).isNotNull(), made)


def checked(answers: DataFrame, references: str = "references", valid: str = "valid") -> DataFrame:
    """answers with kept references, how many were stripped, and the confidence that leaves.

    A reference holds if it is part of something that was supplied, or has it as a part.
    """
    low = F.transform(valid, lambda v: F.lower(v))
    kept = F.filter(
        references, lambda r: F.exists(low, lambda v: F.contains(v, F.lower(r)) | F.contains(F.lower(r), v))
    )
    out = answers.withColumn("kept", kept).withColumn("stripped", F.size(references) - F.size("kept"))
    return out.withColumn(
        "confidence",
        F.when(F.col("stripped") > 0, half_up(F.col("confidence") * 0.7 * 100) / 100).otherwise(F.col("confidence")),
    )


def contexts(repos: DataFrame, detections: DataFrame, brands: DataFrame) -> DataFrame:
    """Rows (repo_id, context): a nested record of a repository, its brand and its detections."""
    items = detections.groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "rule_id", "category", "severity"))).alias("detections")
    )
    rows = repos.join(items, "repo_id", "left").join(brands.select("brand_id", "brand_name"), "brand_id", "left")
    return rows.select("repo_id", F.struct(
        F.struct("full_name", "owner", "stars", "forks").alias("repository"), F.col("brand_name").alias("brand"), F.col("detections").alias("detections")
    ).alias("context"))
