"""What a new scan makes of repositories and findings that earlier ones left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rescan_decision(
    mode: Column,
    force: Column,
    ruleset: Column,
    sha: Column,
    pushed: Column,
    updated: Column,
    old: str = "old",
) -> Column:
    """Struct (analyze, reason) of a repository against its record, a struct column that is null if there is none.

    The record has success_at, failed, ruleset, sha, pushed_at and updated_at. The first reason
    that holds counts; missing times are no change, except that a record without one differs.
    """
    o = lambda n: F.col(f"{old}.{n}")
    say = lambda analyze, reason: F.struct(F.lit(analyze).alias("analyze"), F.lit(reason).alias("reason"))
    some = lambda c: F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    same_rules = o("ruleset").eqNullSafe(ruleset)
    changed = lambda new, was: new.isNotNull() & ~new.eqNullSafe(was)
    return (
        F.when(yes(force) | yes(mode == "full"), say(True, "force_full"))
        .when(F.col(old).isNull(), say(True, "first_seen"))
        .when(yes(mode == "failed_only"), F.when(yes(o("failed")), say(True, "failed_only")).otherwise(say(False, "unchanged")))
        .when(o("success_at").isNull(), say(True, "no_prior_success"))
        .when(yes(o("failed")), say(True, "previous_failed"))
        .when(some(o("ruleset")) & ~same_rules, say(True, "ruleset_changed"))
        .when(some(sha) & some(o("sha")) & (o("sha") == sha) & same_rules, say(False, "unchanged"))
        .when(some(sha) & some(o("sha")) & (o("sha") != sha), say(True, "sha_changed"))
        .when(changed(pushed, o("pushed_at")) | changed(updated, o("updated_at")), say(True, "content_changed"))
        .when(some(o("sha")) & same_rules, say(False, "unchanged"))
        .otherwise(say(True, "no_prior_success"))
    )


def merged_findings(before: DataFrame, seen: DataFrame, as_of: Column, resolve: bool = True) -> DataFrame:
    """Findings after a scan: before(key, status, severity, ...) and seen(key, severity, score).

    New ones open; a false positive stays one; a resolved one reopens; others are unchanged. Open
    and acknowledged ones that weren't seen are resolved, unless only a branch was scanned.
    """
    b, s = before.alias("b"), seen.alias("s")
    rows = b.join(s, F.col("b.key") == F.col("s.key"), "full_outer")
    old, new = F.col("b.key").isNotNull(), F.col("s.key").isNotNull()
    status = F.col("b.status")
    gone = old & ~new & status.isin("open", "acknowledged") & F.lit(resolve)
    change = (
        F.when(~old, "new").when(gone, "resolved").when(~new, F.col("b.last_change_type"))
        .when(status == "resolved", "reopened").otherwise("unchanged")
    )
    now = F.when(~old, "open").when(gone, "resolved").when(new & (status == "resolved"), "open").otherwise(status)
    severity = F.coalesce("s.severity", "b.severity")
    out = rows.select(
        F.coalesce("s.key", "b.key").alias("key"), now.alias("status"), change.alias("last_change_type"), severity.alias("severity"),
        F.coalesce("s.score", "b.score").alias("score"), F.when(gone, as_of).alias("resolved_at"), F.when(change == "reopened", as_of).alias("reopened_at"), new.alias("seen"),
    )
    return out.withColumn(
        "alert",
        F.col("seen") & F.col("last_change_type").isin("new", "reopened") & F.col("severity").isin("critical", "high"),
    )


def has_signal(detections: DataFrame) -> DataFrame:
    """detections of repositories that have more than reputation signals; others make no finding."""
    real = detections.where("rule_id <> 'low-reputation-new-repo'").select("repo_id").distinct()
    return detections.join(real, "repo_id", "left_semi")


def budgeted_claim(
    candidates: DataFrame,
    taken: list[DataFrame],
    most: int,
    order: str,
    already: int = 0,
    key: str = "repo_id",
) -> DataFrame:
    """The first new ids, in order, that no table of `taken` has and that a budget leaves room for."""
    rows = candidates.groupBy(key).agg(F.min(order).alias(order))
    for t in taken:
        rows = rows.join(t.select(key).distinct(), key, "left_anti")
    return rows.orderBy(order, key).limit(max(0, most - already))


def once_only(requests: DataFrame, done: DataFrame, key: str, most: int, by: str, order: str) -> DataFrame:
    """Requests for keys that weren't claimed before, each once, `most` of each group."""
    first = requests.groupBy(by, key).agg(F.min(order).alias(order)).join(done.select(key).distinct(), key, "left_anti")
    turn = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
    return first.withColumn("turn", turn).where(F.col("turn") <= most)


def promoted_keywords(texts: DataFrame, seeds: DataFrame, present: DataFrame, most: int = 2) -> DataFrame:
    """Rows (finding_id, keyword): the first seeded keywords that a text has and that aren't kept yet.

    seeds(ord, keyword) is a short list and is broadcast.
    """
    new = seeds.join(present.select(F.lower("keyword").alias("_k")), F.lower("keyword") == F.col("_k"), "left_anti")
    rows = texts.join(new, F.contains(F.lower("text"), F.lower("keyword")))
    turn = F.row_number().over(Window.partitionBy("finding_id").orderBy("ord"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).select("finding_id", "keyword", "turn")


def with_brand_match(repos: DataFrame, matches: DataFrame) -> DataFrame:
    """repos(repo_id, brand_id, extra: array<long>) with matches(repo_id, brand_id) of other brands appended once."""
    new = matches.groupBy("repo_id").agg(F.array_sort(F.collect_set("brand_id")).alias("_new"))
    rows = repos.join(new, "repo_id", "left")
    fresh = F.filter(
        F.coalesce("_new", F.array().cast("array<bigint>")),
        lambda b: (b != F.col("brand_id")) & ~F.array_contains("extra", b),
    )
    return rows.withColumn("extra", F.concat("extra", fresh)).drop("_new")


def resume_page(last_page: Column, exhausted: Column) -> Column:
    return F.when(last_page.isNull() | F.coalesce(exhausted, F.lit(False)), 1).otherwise(last_page + 1)


def has_more(page: Column, received: Column, total: Column, per_page: int = 100, most: int = 1000) -> Column:
    """Whether a search has another page: this one was full, and neither the hits nor the host's cap are used up."""
    return (received >= per_page) & (page * per_page < F.least(total, F.lit(most)))


def reusable(assessments: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(context_hash, ...) without those of which a completed assessment has the context."""
    return wanted.join(
        assessments.where("status = 'completed'").select("context_hash").distinct(), "context_hash", "left_anti"
    )


def needs_deep_review(intent: Column, confidence: Column, flagged: Column) -> Column:
    return F.coalesce(flagged, F.lit(False)) | (intent == "inconclusive") | (confidence < 0.5)


def triaged(status: Column, resolved_at: Column, as_of: Column) -> Column:
    """When a finding counts as resolved after an analyst set its status."""
    return F.when(status.isin("resolved", "false_positive"), F.coalesce(resolved_at, as_of)).when(
        status.isin("open", "acknowledged"), None
    ).otherwise(resolved_at)


def scan_outcome(cancelled: Column, processed: Column, failed: Column) -> Column:
    return (
        F.when(cancelled, "cancelled").when((failed > 0) & (processed > failed), "partially_completed")
        .when((failed > 0) & (processed <= failed), "failed").otherwise("completed")
    )


def scan_counters(units: DataFrame) -> DataFrame:
    """Rows of a scan's sums over units(scan_id, repo_id, outcome, high_risk): how much of what was done."""
    return units.groupBy("scan_id").agg(
        F.count("*").alias("processed"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.coalesce("high_risk", F.lit(False))).alias("high_risk"), F.array_sort(F.collect_set("repo_id")).alias("repo_ids"),
    )


def backfilled_origin(repos: DataFrame, scans: DataFrame) -> DataFrame:
    """repos with a missing origin set by the last scan: internal after an internal audit, else external."""
    audits = scans.where("scope = 'internal_audit'").select(F.col("scan_id").alias("_audit")).distinct()
    rows = repos.join(audits, F.col("last_scan_id") == F.col("_audit"), "left")
    return rows.withColumn(
        "origin", F.coalesce("origin", F.when(F.col("_audit").isNotNull(), "internal").otherwise("external"))
    ).drop("_audit")
