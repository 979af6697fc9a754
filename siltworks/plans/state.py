"""Queries of incremental decisions, discovery, rotation and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import intent, lifecycle, rotation, scoring, views
from siltworks.plans import discovery
from siltworks.plans.catalog import query
from siltworks.plans.matching import brands


@query("decide_rescan", "O143", """
select r.repo_id, case when r.repo_id % 20 = 19 then 'force_full' when r.repo_id % 20 = 18 then 'first_seen'
  when r.repo_id % 20 = 17 then 'failed_only' when r.repo_id % 20 = 16 then 'unchanged' when r.is_fork
  then 'no_prior_success'
  when r.forks = 3 then 'previous_failed' when r.forks % 10 = 4 then 'ruleset_changed' when r.commit_sha is not null
    and r.stars % 2 = 0 then 'unchanged' when r.commit_sha is not null then 'sha_changed'
  when r.pushed_at is not null then 'content_changed' else 'no_prior_success' end as reason from {repositories} r""")
def _(t):
    r = t("repositories")
    old = F.when(F.col("repo_id") % 20 != 18, F.struct(
        F.when(~F.col("is_fork"), F.lit("2024-01-01")).alias("success_at"), ((F.col("forks") == 3) | (F.col("repo_id") % 20 == 17)).alias("failed"), F.when(F.col("forks") % 10 == 4, "r0").otherwise("r1").alias("ruleset"),
        F.when(F.col("stars") % 2 == 0, F.col("commit_sha")).otherwise(F.concat(F.col("commit_sha"), F.lit("x"))).alias("sha"), F.lit(None).cast("timestamp_ntz").alias("pushed_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    ))
    mode = F.when(F.col("repo_id") % 20 == 19, "full").when(
        F.col("repo_id") % 20 >= 16, F.when(F.col("repo_id") % 20 == 18, "incremental").otherwise("failed_only")
    ).otherwise("incremental")
    said = lifecycle.rescan_decision(
        mode, F.lit(False), F.lit("r1"), F.col("commit_sha"), F.col("pushed_at"), F.lit(None).cast("timestamp_ntz")
    )
    rows = r.withColumn("old", old)
    rows = rows.withColumn(
        "old",
        F.when(
            (F.col("repo_id") % 20 == 16) & F.col("old").isNotNull(), F.col("old").withField("failed", F.lit(False))
        ).otherwise(F.col("old")),
    )
    return rows.select("repo_id", said["reason"].alias("reason"))


@query("finding_lifecycle", "O144 O146", """
with b as (select finding_id as key, coalesce(status, 'open') as status, severity from {findings}
  where finding_id % 5 > 0), s as (select finding_id as key, severity from {findings} where finding_id % 3 > 0)
select coalesce(s.key, b.key) as key,
  case when b.key is null then 'open' when s.key is null and b.status in ('open', 'acknowledged') then 'resolved'
    when s.key is not null and b.status = 'resolved' then 'open' else b.status end as status,
  case when b.key is null then 'new' when s.key is null and b.status in ('open', 'acknowledged') then 'resolved'
    when s.key is null then 'unchanged' when b.status = 'resolved' then 'reopened' else 'unchanged' end as change,
  s.key is not null and (b.key is null or b.status = 'resolved') and coalesce(s.severity, b.severity) in ('critical',
    'high') as alert
from b full join s on s.key = b.key""")
def _(t):
    f = t("findings").selectExpr(
        "finding_id as key",
        "coalesce(status, 'open') as status",
        "severity",
        "risk_score as score",
        "'unchanged' as last_change_type",
    )
    out = lifecycle.merged_findings(
        f.where("key % 5 > 0"),
        f.where("key % 3 > 0").select("key", "severity", "score"),
        F.lit("2024-01-10").cast("timestamp"),
    )
    return out.select("key", "status", F.col("last_change_type").alias("change"), "alert")


@query("keyword_promotion", "O147", """
select finding_id, keyword, turn from (select f.finding_id, k.keyword, row_number() over (partition by f.finding_id
  order by k.ord) as turn
from {findings} f
  join (values (1, 'urgent'), (2, 'order'), (3, 'summary'), (4, 'high')) k(ord, keyword) on contains(f.summary,
  k.keyword) where k.keyword not in ('summary')) x where turn <= 2""")
def _(t):
    seeds = t.rows([(1, "urgent"), (2, "order"), (3, "Summary"), (4, "high")], "ord int, keyword string")
    out = lifecycle.promoted_keywords(
        t("findings").selectExpr("finding_id", "summary as text"), seeds, t.rows([("SUMMARY",)], "keyword string")
    )
    return out.withColumn("turn", F.col("turn").cast("long"))


@query("additional_brands", "O148", """
select repo_id, array_to_string(list_sort(list_distinct([repo_id % 4] || coalesce(m, []))), ',') as brands
  from (select r.repo_id, list(b) filter (where b is not null) as m from {repositories} r
left join (select distinct repo_id, finding_id % 4 as b from {findings}) f on f.repo_id = r.repo_id
  group by r.repo_id) x""")
def _(t):
    r = t("repositories").selectExpr("repo_id", "repo_id % 4 as brand_id", "cast(array() as array<bigint>) as extra")
    out = lifecycle.with_brand_match(r, t("findings").selectExpr("repo_id", "finding_id % 4 as brand_id"))
    return out.select(
        "repo_id", F.array_join(F.array_sort(F.concat(F.array("brand_id"), "extra")), ",").alias("brands")
    )


@query("search_cursors", "O149", """
select event_id, case when event_id % 5 = 0 or event_id % 7 = 0 then 1 else event_id % 12 + 1 end as page,
  event_id % 130 >= 100 and (event_id % 12) * 100 < least(event_id, 1000) as more from {events}""")
def _(t):
    last = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 12)
    more = lifecycle.has_more(F.col("event_id") % 12, F.col("event_id") % 130, F.col("event_id"))
    return t("events").select(
        "event_id", lifecycle.resume_page(last, F.col("event_id") % 7 == 0).alias("page"), more.alias("more")
    )


@query("assessment_reuse", "O150", """
select repo_id, context from (select repo_id, 'ctx' || cast(repo_id % 70 as string) as context from {repositories}) x
  where context not in (select context_hash from {assessments} where status = 'completed')""")
def _(t):
    wanted = t("repositories").selectExpr("repo_id", "concat('ctx', repo_id % 70) as context_hash")
    return lifecycle.reusable(t("assessments"), wanted).select("repo_id", F.col("context_hash").alias("context"))


@query(
    "deep_review",
    "O150",
    """
select assessment_id, assessment_id % 9 = 0 or intent = 'inconclusive' or confidence < 0.5 as deep
  from {assessments}""",
)
def _(t):
    return t("assessments").select(
        "assessment_id",
        lifecycle.needs_deep_review(F.col("intent"), F.col("confidence"), F.col("assessment_id") % 9 == 0).alias("deep"),
    )


@query(
    "triage",
    "O151",
    """
select finding_id, case when status in ('resolved', 'false_positive') then timestamp '2024-01-10'
  when status in ('open', 'acknowledged') then null else created_at end as resolved_at from {findings}""",
)
def _(t):
    at = F.when(F.col("status").isNull(), F.col("created_at"))
    return t("findings").select(
        "finding_id",
        lifecycle.triaged(F.col("status"), at, F.lit("2024-01-10").cast("timestamp_ntz")).alias("resolved_at"),
    )


@query("rotation_schedule", "O152", """
select ws, ord, 1000 + starts as starts
  from (select ord % 2 as ws, ord, coalesce(sum(priority * 60000) over (partition by ord % 2
  order by ord rows between unbounded preceding and 1 preceding), 0)::double as starts from {keywords}
  where enabled) x""")
def _(t):
    slots = t("keywords").selectExpr(
        "ord % 2 as workspace_id", "ord", "keyword", "priority * 60000 as duration_ms", "not enabled as paused"
    )
    return rotation.schedule(slots, F.lit(1000)).select(
        F.col("workspace_id").alias("ws"), "ord", F.col("starts").cast("double").alias("starts")
    )


@query("typo_variants", "O79", """
select p_partkey, array_to_string([b || '-login', b || 'login', b || '-apk', b || 'apk', b || '-otp', b || 'otp',
  b || '-verify', b || 'verify'], ',') as few from (select p_partkey, replace(lower(p_name), ' ', '') as b
  from {part}) x""")
def _(t):
    return t("part").select("p_partkey", F.array_join(discovery.variants(F.col("p_name")), ",").alias("few"))


@query("citations", "O90", """
select item_id, kept, cast(3 - kept as int) as stripped, case when kept < 3 then floor(0.83 * 0.7 * 100 + 0.5) / 100
  else 0.83 end as confidence from (select item_id, cast(case when item_id % 2 = 0 then 3 else 2 end as int) as kept
  from {benchmark}) x""")
def _(t):
    rows = t("benchmark").select(
        "item_id", F.lit(0.83).alias("confidence"), F.array(F.lit("README.md section"), F.lit("Phish"), F.when(F.col("item_id") % 2 == 0, "owner/x").otherwise("made up")).alias("references"),
        F.array(F.lit("readme"), F.lit("phishing-kit"), F.lit("Owner/X")).alias("valid"),
    )
    return intent.checked(rows).select("item_id", F.size("kept").alias("kept"), "stripped", "confidence")


@query("intent_contexts", "O172", """
select r.repo_id, b.brand_name as brand, count(d.finding_id) as detections from {repositories} r left
  join {brands} b on b.brand_id = r.brand_id left join {detections} d on d.finding_id = r.repo_id
  group by r.repo_id, b.brand_name""")
def _(t):
    d = t("detections").withColumnRenamed("finding_id", "repo_id")
    return intent.contexts(t("repositories"), d, t("brands")).select(
        "repo_id",
        F.col("context.brand").alias("brand"),
        F.greatest(F.lit(0), F.coalesce(F.size("context.detections"), F.lit(0))).cast("long").alias("detections"),
    )


@query(
    "alerts",
    "O146",
    """
select finding_id from {findings} where last_change_type in ('new', 'reopened') and severity in ('critical', 'high')""",
)
def _(t):
    return t("findings").where("last_change_type in ('new', 'reopened') and severity in ('critical', 'high')").select(
        "finding_id"
    )


