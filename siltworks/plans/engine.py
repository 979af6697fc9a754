"""Queries of filters, joins, aggregates and windows over findings and repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import dates
from siltworks.operators import lifecycle, scoring, sinks, views
from siltworks.plans.catalog import Tables, listed, query


def findings(t: Tables):
    return t("findings").withColumn("categories", listed("categories"))


@query("findings_filtered", "O15 O16 O17 O29", """
select finding_id, severity, brand_name from {findings}
where workspace_id = 'ws1' and origin = 'external' and severity = 'critical' and list_contains(string_split(categories,
  ','), 'phishing')
  and regexp_matches(brand_name, '(?i)auto|mach') and created_at >= timestamp '1996-01-01'
    and created_at <= timestamp '2000-12-31'
  and (regexp_matches(summary, '(?i)order .*7') or regexp_matches(brand_name, '(?i)order .*7'))""")  # fmt: skip
def _(t):
    rows = views.findings_filter(
        findings(t), equal={"workspace_id": "ws1", "origin": "external", "severity": "critical", "status": None}, category="phishing",
        threat_class="malicious_intent", brand="auto|mach", search="order .*7", start="1996-01-01", stop="2000-12-31",
    )
    return rows.select("finding_id", "severity", "brand_name")


@query("findings_by_threat_class", "O16 O85", """
select finding_id, case when c and m then 'credential_exposure,malicious_intent' when c then 'credential_exposure'
  when m then 'malicious_intent' else 'other' end as classes
from (select finding_id, regexp_matches(categories, 'exposed_secret|credential_reuse') c, regexp_matches(categories,
  'phishing|malware|fake_apk|brand_impersonation') m from {findings}) x""")
def _(t):
    return findings(t).select(
        "finding_id", F.array_join(scoring.threat_classes(F.col("categories")), ",").alias("classes")
    )


@query("repositories_filtered", "O18", """
select repo_id, full_name, language from {repositories}
  where origin = 'external' and pending_analysis = false and regexp_matches(full_name, '(?i)MACH|auto')
  and lower(language) = 'python' and created_at >= timestamp '2024-01-01' and created_at <= timestamp '2024-06-30'
    and pushed_at >= timestamp '2024-01-02'""")
def _(t):
    rows = views.repositories_filter(
        t("repositories"),
        pending=False,
        name="MACH|auto",
        language="PYTHON",
        created=("2024-01-01", "2024-06-30"),
        pushed=("2024-01-02", None),
    )
    return rows.select("repo_id", "full_name", "language")


@query(
    "deployment_tristate",
    "O10 O19",
    """
select brand_id, count(homepage) as deployed, count(*) - count(homepage) as not_deployed, count(*) as whole
  from {repositories} group by brand_id""",
)
def _(t):
    r = t("repositories")
    sides = [views.deployed(F.col("homepage"), x).cast("int") for x in (True, False, None)]
    return r.groupBy("brand_id").agg(
        *(F.sum(s).alias(n) for s, n in zip(sides, ("deployed", "not_deployed", "whole"), strict=True))
    )


@query("activity_window", "O20 O21", """
select repo_id, coalesce(created_at >= timestamp '2024-01-01 12:00:00'
  and created_at <= timestamp '2024-01-02 23:59:59.999', false) as created_in,
  coalesce(created_at <= timestamp '2024-01-02 23:59:59.999', false) or coalesce(pushed_at >= timestamp '2024-01-03',
    false) as either,
  coalesce(created_at <= timestamp '2024-01-02 23:59:59.999', false) and coalesce(pushed_at >= timestamp '2024-01-03',
    false) as both_sides, true as unbounded from {repositories}""")
def _(t):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    c, p, stop = F.col("created_at"), F.col("pushed_at"), (None, at("2024-01-02 08:00:00"))
    return t("repositories").select(
        "repo_id", dates.active(c, p, (at("2024-01-01 12:00:00"), at("2024-01-02")), (None, None)).alias("created_in"),
        dates.active(c, p, stop, (at("2024-01-03"), None), "or").alias("either"), dates.active(c, p, stop, (at("2024-01-03"), None)).alias("both_sides"),
        dates.active(c, p, (None, None), (None, None)).alias("unbounded"),
    )


@query("backlog_counts", "O22", """
select brand_id, count(*) filter (where pending_analysis and created_at >= timestamp '2024-01-02') as pending,
  count(*) filter (where not pending_analysis and origin = 'external') as analysed from {repositories}
    group by brand_id""")
def _(t):
    return t("repositories").groupBy("brand_id").agg(
        F.count_if(F.col("pending_analysis") & views.between(F.col("created_at"), "2024-01-02")).alias("pending"),
        F.count_if(~F.col("pending_analysis") & (F.col("origin") == "external")).alias("analysed"),
    )


@query("unassessed_findings", "O23 O170", """
select finding_id from {findings} where origin = 'external' and scoring_source is distinct
  from 'ai' and status is distinct from 'false_positive' order by finding_id limit 50""")
def _(t):
    rows = t("findings").where(
        (F.col("origin") == "external") & views.is_not(F.col("scoring_source"), "ai") & views.is_not(
            F.col("status"), "false_positive"
        )
    )
    return rows.select("finding_id").orderBy("finding_id").limit(50)


@query("findings_page", "O27 O128", """
select finding_id, severity, (select count(*) from {findings} where workspace_id = 'ws0') as total from {findings}
where workspace_id = 'ws0' order by severity desc, finding_id limit 20 offset 40""")
def _(t):
    rows = t("findings").where("workspace_id = 'ws0'")
    total = rows.agg(F.count("*").alias("total"))
    return views.page(views.sorted_by(rows, "severity", "desc", "finding_id"), 3, 20).join(total, F.lit(True)).select(
        "finding_id", "severity", "total"
    )


@query(
    "unknown_sort_is_by_creation",
    "O27",
    "select finding_id from {findings} order by created_at asc, finding_id limit 100",
)
def _(t):
    return views.page(views.sorted_by(t("findings"), "no such column", "asc", "finding_id"), 1, 1000).select(
        "finding_id"
    )


@query("finding_with_repository", "O98", """
select f.finding_id, r.full_name from {findings} f left join (select * from {repositories}
  where not is_fork) r on r.repo_id = f.repo_id""")
def _(t):
    return t("findings").join(
        t("repositories").where("not is_fork").select("repo_id", "full_name"), "repo_id", "left"
    ).select("finding_id", "full_name")


@query(
    "detections_of_findings",
    "O99",
    """
select f.status, count(*) as n from {detections} d join {findings} f on f.finding_id = d.finding_id
  group by f.status""",
)
def _(t):
    return t("detections").join(t("findings").select("finding_id", "status"), "finding_id").groupBy("status").agg(
        F.count("*").alias("n")
    )


@query(
    "semi_eligible",
    "O100",
    """
select severity, count(*) as n from {findings} where repo_id in (select repo_id from {repositories}
  where not pending_analysis) group by severity""",
)
def _(t):
    return views.eligible_findings(t("findings"), t("repositories")).groupBy("severity").agg(F.count("*").alias("n"))


@query("located_repositories", "O101", """
with f as (select repo_id, case finding_id % 3 when 0 then 'readme' else 'file_path' end loc from {findings}
  where finding_id % 4 = 0),
r as (select repo_id, case repo_id % 2 when 0 then 'readme' else 'description' end field from {repositories})
select repo_id from r where repo_id in (select repo_id from f
  where loc = 'readme') or (field = 'readme' and repo_id not in (select repo_id from f))""")
def _(t):
    f = t("findings").where("finding_id % 4 = 0").select(
        "repo_id", F.expr("case finding_id % 3 when 0 then 'readme' else 'file_path' end").alias("match_location")
    )
    r = t("repositories").select(
        "repo_id", F.expr("case repo_id % 2 when 0 then 'readme' else 'description' end").alias("discovery_field")
    )
    return views.located(r, f, "readme").select("repo_id")


@query("linked_identities", "O103", """
select a.repo_id, a.kind, a.value, b.repo_id as other_repo, b.owner as other_owner from {identities} a
join {identities} b on a.workspace_id = b.workspace_id and a.kind = b.kind and a.value = b.value
  and a.repo_id <> b.repo_id""")
def _(t):
    return views.linked_identities(t("identities"))


@query("shared_contributors", "O104", """
select c.repo_id, c.login, c.contributions, coalesce(string_agg(o.full_name, ',' order by o.repo_id), '') as others
from {contributors} c left join (select distinct x.login, r.repo_id, r.full_name from {contributors} x
  join {repositories} r on r.repo_id = x.repo_id) o
  on o.login = c.login and o.repo_id <> c.repo_id group by c.repo_id, c.login, c.contributions""")
def _(t):
    return views.shared_contributors(t("contributors"), t("repositories"))


@query("linked_owner_counts", "O105", """
select a.workspace_id, a.owner, count(distinct b.owner) as linked_owners from {identities} a join {identities} b
  on a.workspace_id = b.workspace_id and a.kind = b.kind and a.value = b.value and a.owner <> b.owner
where b.repo_id in (select repo_id from {findings} where status is distinct from 'false_positive')
  group by a.workspace_id, a.owner""")
def _(t):
    return views.linked_owner_counts(t("identities"), t("findings"))


@query("repeat_operators", "O106", """
select a.repo_id, count(distinct f.brand_name) as other_brands from {repositories} a
  join {repositories} b on a.workspace_id = b.workspace_id and a.owner = b.owner and a.repo_id <> b.repo_id
join {findings} f on f.repo_id = b.repo_id where f.status is distinct from 'false_positive' and f.brand_name <> ''
  group by a.repo_id""")
def _(t):
    return views.repeat_operators(t("repositories"), t("findings"))


@query("contributor_overlap", "O107", """
select repo_id, count(distinct login) as shared from {contributors} where login in (select login from {contributors}
  group by login having count(distinct repo_id) > 1) group by repo_id""")
def _(t):
    return views.contributor_overlap(t("contributors"))


@query("match_info", "O108 O131", """
select r.repo_id, f.finding_id, f.risk_score, coalesce(nullif(f.brand_name, ''), b.brand_name,
  'unknown') as matched_brand, f.finding_id is not null as confirmed
from {repositories} r left join (select *, row_number() over (partition by repo_id
  order by risk_score desc, finding_id) rn from {findings}) f on f.repo_id = r.repo_id and rn = 1
left join {brands} b on b.brand_id = r.brand_id""")
def _(t):
    return views.match_info(t("repositories"), t("findings"), t("brands"))


@query("slots_known", "O109", """
select s.ord, list_contains(string_split(lower(b.keywords), ','), lower(trim(s.keyword))) as known
  from (select ord, keyword, ord % 4 as brand_id from {keywords}) s join {brands} b on b.brand_id = s.brand_id""")
def _(t):
    slots = t("keywords").selectExpr("ord", "trim(keyword) as keyword", "ord % 4 as brand_id")
    return views.slots_known(slots, t("brands").withColumn("keywords", F.split("keywords", ","))).select("ord", "known")


@query("dashboard_counts", "O112", """
select (select count(*) from {findings}) as total, (select count(*) from {findings}
  where severity = 'critical') as critical,
  (select count(*) from {findings} where severity = 'high') as high, (select count(*)
    from {repositories}) as repositories,
  (select count(*) from {findings} where severity in ('critical', 'high') and finding_id % 2 = 0) as unread""")
def _(t):
    alerts = t("findings").where("severity in ('critical', 'high')").selectExpr(
        "finding_id", "finding_id % 2 = 1 as read"
    )
    return views.dashboard(t("findings"), t("repositories"), alerts)


@query("findings_by_severity", "O113", "select severity, count(*) as n from {findings} group by severity")
def _(t):
    return t("findings").groupBy("severity").agg(F.count("*").alias("n"))


@query(
    "category_unwind_counts",
    "O114",
    """
select c as category, count(*) as n from (select unnest(string_split(categories, ',')) as c from {findings}) x
  where c <> '' group by c""",
)
def _(t):
    return findings(t).select(F.explode("categories").alias("category")).groupBy("category").agg(
        F.count("*").alias("n")
    )


@query(
    "daily_histogram_oldest30",
    "O115",
    "select strftime(created_at, '%Y-%m-%d') as day, count(*) as n from {findings} group by 1 order by 1 limit 30",
)
def _(t):
    return views.daily_histogram(t("findings"), "created_at")


@query("rule_precision_two_level", "O116", """
select rule_id, max(rule_name) as rule_name, count(*) as findings, cast(sum(case when status = 'false_positive' then 1
  else 0 end) as bigint) as false_positives,
  floor(sum(case when status = 'false_positive' then 1 else 0 end) / count(*) * 100 + 0.5) / 100 as rate
from (select distinct rule_id, rule_name, finding_id from {detections}) d
  join {findings} f on f.finding_id = d.finding_id group by rule_id""")
def _(t):
    return views.rule_precision(t("detections"), t("findings"))


@query("active_by_keyword", "O117", """
select brand_name as keyword, cast(sum(coalesce(risk_score, 0)) as bigint) as found, cast(sum(coalesce(repo_id,
  0)) as bigint) as analysed, max(finding_id) as scan_id,
  arg_max(severity, finding_id) as status from {findings} group by brand_name""")
def _(t):
    return views.active_by_keyword(
        t("findings").selectExpr(
            "brand_name as keyword",
            "risk_score as found",
            "repo_id as analysed",
            "finding_id as scan_id",
            "severity as status",
        )
    )


@query(
    "assessment_stats",
    "O119",
    "select tier, status, provider, count(*) as n from {assessments} group by tier, status, provider",
)
def _(t):
    return t("assessments").groupBy("tier", "status", "provider").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("distinct_languages", "O120", "select distinct language from {repositories} where language <> ''")
def _(t):
    return t("repositories").where("language is not null and language <> ''").select("language").distinct().orderBy(
        "language"
    )


@query("top_phrases_per_brand", "O121", """
with p as (select item_id as phrase_id, item_id % 4 as brand_id, length(text) as significant_words from {benchmark}),
best as (select * from p order by significant_words desc, phrase_id limit 30)
select brand_id, phrase_id, turn from (select *, row_number() over (partition by brand_id
  order by significant_words desc, phrase_id) as turn from best) x where turn <= 3""")
def _(t):
    p = t("benchmark").selectExpr(
        "item_id as phrase_id", "item_id % 4 as brand_id", "length(text) as significant_words"
    )
    return views.top_phrases(p, 3, 30).select("brand_id", "phrase_id", F.col("turn").cast("long").alias("turn"))


@query("contributor_rollup", "O122", """
select c.login, count(distinct c.repo_id) as repos, count(distinct r.owner) as owners from {contributors} c
  join {repositories} r on r.repo_id = c.repo_id group by c.login having count(distinct c.repo_id) >= 2""")
def _(t):
    return views.contributor_rollup(t("contributors"), t("repositories"))


@query("scan_counters", "O123 O126", """
select cast(finding_id % 20 as bigint) as scan_id, count(*) as processed,
  count(*) filter (where severity = 'low') as failed, count(*) filter (where severity = 'medium') as skipped,
  count(*) filter (where risk_score > 80) as high_risk, cast(count(distinct repo_id) as bigint) as repos from {findings}
    group by 1""")
def _(t):
    units = t("findings").selectExpr(
        "finding_id % 20 as scan_id", "repo_id", "case severity when 'low' then 'failed' when 'medium' then 'skipped' else 'done' end as outcome", "risk_score > 80 as high_risk"
    )
    return lifecycle.scan_counters(units).withColumn("repos", F.size("repo_ids").cast("long")).drop("repo_ids")


@query("scan_outcome", "O124", """
select repo_id, case when is_fork then 'cancelled' when forks > 30 and stars > forks then 'partially_completed'
  when forks > 30 then 'failed' else 'completed' end as outcome from {repositories}""")
def _(t):
    failed = F.when(F.col("forks") > 30, F.col("forks")).otherwise(0)
    return t("repositories").select(
        "repo_id", lifecycle.scan_outcome(F.col("is_fork"), F.col("stars"), failed).alias("outcome")
    )


@query(
    "active_rollup",
    "O127",
    """
select workspace_id, cast(sum(stars) as bigint) as total, count(*) filter (where not is_fork) as visible
  from {repositories} group by workspace_id""",
)
def _(t):
    return t("repositories").groupBy("workspace_id").agg(
        F.sum("stars").alias("total"), F.count_if(~F.col("is_fork")).alias("visible")
    )


@query("risk_score", "O125 O86 O126", """
with p as (
  select *, risk_contribution * (0.5 + confidence * 0.5) as raw, row_number() over (partition by finding_id, rule_id
    order by risk_contribution * (0.5 + confidence * 0.5) desc, ord) - 1 as rank from {detections}
), s as (
  select finding_id, sum(floor(raw * pow(0.6, rank) + 0.5)) as base, count(distinct category) as n,
    bool_or(category in ('phishing', 'malware', 'fake_apk', 'brand_impersonation')) as intent from p group by finding_id
), c as (
  select s.finding_id, base + case when n >= 3 then 10 when n = 2 then 5 else 0 end + case when not intent then 0
    when stars >= 1000 and forks / stars >= 0.02 then -12
    when stars >= 1000 then 6 when stars <= 1 then 6 else 0 end + case when intent
      and epoch(timestamp '2024-01-10' - r.created_at) <= 14 * 86400 then 8 else 0 end as raw_score
  from s join {findings} f on f.finding_id = s.finding_id left join {repositories} r on r.repo_id = f.repo_id
)
select finding_id, cast(greatest(0, least(100, raw_score)) as bigint) as score,
  case when raw_score >= 85 then 'critical' when raw_score >= 65 then 'high' when raw_score >= 40 then 'medium'
    else 'low' end as severity from c""")
def _(t):
    repos = t("findings").select("finding_id", "repo_id").join(
        t("repositories").select("repo_id", "stars", "forks", "created_at"), "repo_id", "left"
    ).drop("repo_id")
    return scoring.scores(t("detections"), repos, "finding_id", F.lit("2024-01-10").cast("timestamp")).select(
        "finding_id", "score", "severity"
    )


@query(
    "severity_bands",
    "O86",
    """
select risk_score, case when risk_score >= 85 then 'critical' when risk_score >= 65 then 'high' when risk_score >= 40
  then 'medium' else 'low' end as band from {findings} group by risk_score""",
)
def _(t):
    return t("findings").select("risk_score").distinct().withColumn("band", scoring.severity(F.col("risk_score")))


@query(
    "recent_high_severity",
    "O129",
    """
select finding_id from {findings} where severity in ('critical', 'high')
  order by created_at desc, finding_id limit 5""",
)
def _(t):
    return t("findings").where("severity in ('critical', 'high')").orderBy(F.desc("created_at"), "finding_id").limit(
        5
    ).select("finding_id")


@query("recent_changes", "O130", """
select * from (select 'push' as kind, repo_id, full_name from {repositories} where pushed_at >= timestamp '2024-01-05'
  order by pushed_at desc, repo_id limit 8) a
union all
select last_change_type, f.repo_id, r.full_name from (select * from {findings}
  where created_at >= timestamp '2000-01-01' and last_change_type in ('new', 'reopened')
  order by created_at desc, finding_id limit 8) f join (select * from {repositories}
    where repo_id % 3 > 0) r on r.repo_id = f.repo_id""")
def _(t):
    r = t("repositories")
    pushed = views.recent_changes(r, t("findings").limit(0), "2024-01-05").where("kind = 'push'")
    changed = views.recent_changes(r.where("repo_id % 3 > 0"), t("findings"), "2000-01-01").where("kind <> 'push'")
    return pushed.unionByName(changed).select("kind", "repo_id", "full_name")


@query(
    "top1_per_group",
    "O131",
    """
select repo_id, finding_id from (select *, row_number() over (partition by repo_id
  order by risk_score desc, finding_id) rn from {findings}) x where rn = 1""",
)
def _(t):
    return views.top_per_repository(t("findings")).select("repo_id", "finding_id")


@query("top_keywords_by_category", "O132", """
select category, keyword, turn from (select *, row_number() over (partition by category
  order by priority desc, lower(keyword), keyword) turn from {keywords} where enabled) x where turn <= 2""")
def _(t):
    return views.top_keywords(t("keywords"), 2).select("category", "keyword", F.col("turn").cast("long").alias("turn"))


@query(
    "latest_per_key",
    "O133",
    """
select repo_id, assessment_id, intent from (select *, row_number() over (partition by repo_id
  order by created_at desc, assessment_id desc) rn from {assessments}) x where rn = 1""",
)
def _(t):
    return views.latest(t("assessments"), "repo_id", ["created_at", "assessment_id"]).select(
        "repo_id", "assessment_id", "intent"
    )


@query("budgeted_claim", "O134", """
select repo_id, first from (select repo_id, min(finding_id) as first from {findings} group by repo_id) x
where repo_id not in (select repo_id from {repositories} where is_fork) and repo_id not in (select repo_id
  from {contributors} where contributions > 30) order by first, repo_id limit 25""")
def _(t):
    taken = [t("repositories").where("is_fork"), t("contributors").where("contributions > 30")]
    return lifecycle.budgeted_claim(
        t("findings").withColumnRenamed("finding_id", "first"), taken, 30, "first", already=5
    )


@query("once_only_claim", "O135", """
select workspace_id, owner, turn from (select *, row_number() over (partition by workspace_id
  order by first, owner) as turn from (
  select workspace_id, owner, min(repo_id) as first from {repositories} where owner not in (select owner
    from {repositories} where is_fork and repo_id < 30) group by workspace_id, owner) x) y where turn <= 5""")
def _(t):
    r = t("repositories")
    rows = lifecycle.once_only(
        r.withColumn("first", F.col("repo_id")),
        r.where("is_fork and repo_id < 30"),
        "owner",
        5,
        "workspace_id",
        "first",
    )
    return rows.select("workspace_id", "owner", F.col("turn").cast("long").alias("turn"))


@query(
    "union_of_ids",
    "O137",
    "select repo_id from {repositories} where is_fork union select repo_id from {findings} where severity = 'critical'",
)
def _(t):
    return t("repositories").where("is_fork").select("repo_id").union(
        t("findings").where("severity = 'critical'").select("repo_id")
    ).distinct()


@query("intersect_and_except", "O138 O139", """
select 'both' as side, count(*) as n from (select repo_id from {findings}
  where severity = 'critical' intersect select repo_id from {contributors}) x
union all select 'rest', count(*) from (select repo_id from {repositories} except select repo_id from {findings}) y""")
def _(t):
    critical = t("findings").where("severity = 'critical'").select("repo_id")
    both = critical.intersect(t("contributors").select("repo_id")).agg(
        F.lit("both").alias("side"), F.count("*").alias("n")
    )
    return both.union(
        t("repositories").select("repo_id").subtract(t("findings").select("repo_id")).agg(F.lit("rest"), F.count("*"))
    )


@query("scan_list", "O163", """
select assessment_id, status, (select count(*) from {assessments} where status in ('failed', 'pending')) as total
  from {assessments} where status in ('failed', 'pending')
order by created_at desc, assessment_id limit 10 offset 10""")
def _(t):
    rows = t("assessments").where(F.col("status").isin("failed", "pending"))
    total = rows.agg(F.count("*").alias("total"))
    return views.page(views.sorted_by(rows, None, None, "assessment_id"), 2, 10).join(total, F.lit(True)).select(
        "assessment_id", "status", "total"
    )


@query(
    "dimension_lists",
    "O173",
    "select 'brand' as kind, brand_name as name from {brands} union all select 'keyword', keyword from {keywords}",
)
def _(t):
    brands = t("brands").select(F.lit("brand").alias("kind"), F.col("brand_name").alias("name")).orderBy("name")
    return brands.union(t("keywords").select(F.lit("keyword"), "keyword").orderBy("keyword"))


@query("upserted_repositories", "O11", """
with o as (select repo_id, stars, language from {repositories}
  where repo_id % 3 > 0), n as (select repo_id, stars + 1 as stars, cast(null as string) as language, forks
  from {repositories} where repo_id % 2 = 0)
select coalesce(n.repo_id, o.repo_id) as repo_id, coalesce(n.stars, o.stars) as stars, coalesce(n.language,
  o.language) as language, n.forks from o full join n on n.repo_id = o.repo_id""")
def _(t):
    r = t("repositories")
    new = r.where("repo_id % 2 = 0").selectExpr(
        "repo_id", "stars + 1 as stars", "cast(null as string) as language", "forks"
    )
    return sinks.upserted(r.where("repo_id % 3 > 0").select("repo_id", "stars", "language"), new, ["repo_id"])


@query("inserted_if_absent", "O12 O174", """
select k.keyword, k.ord from (select min(ord) as ord from {keywords} where ord <= 4 group by ord) o
  join {keywords} k on k.ord = o.ord
union all select keyword, ord from (select *, row_number() over (partition by lower(keyword) order by ord) rn
  from {keywords} where ord > 4) n where rn = 1
  and lower(keyword) not in (select lower(keyword) from {keywords} where ord <= 4)""")
def _(t):
    k = t("keywords").select("ord", "keyword")
    return sinks.inserted_if_absent(k.where("ord <= 4"), k.where("ord > 4"), ["keyword"], fold_case=True).select(
        "keyword", "ord"
    )


@query("replaced_set", "O13", """
select repo_id, login from {contributors} where repo_id not in (select repo_id from {contributors}
  where repo_id % 4 = 0) union all select repo_id, login from {contributors}
  where repo_id % 4 = 0 and contributions > 20""")
def _(t):
    c = t("contributors")
    current = c.where("repo_id % 4 = 0 and contributions > 20")
    scopes = c.where("repo_id % 4 = 0").select("repo_id").distinct()
    return c.join(scopes, "repo_id", "left_anti").select("repo_id", "login").unionByName(
        sinks.replaced_set(current.limit(0).select("repo_id", "login"), current.select("repo_id", "login"), ["repo_id"])
    )


@query("backfilled_origin", "O162", """
select repo_id, coalesce(origin, case when repo_id % 10 in (1, 3, 9) then 'internal' else 'external' end) as origin
  from {repositories}""")
def _(t):
    r = t("repositories").withColumn("last_scan_id", F.col("repo_id") % 10)
    scans = t.rows(
        [(k, "internal_audit" if k in (1, 3, 9) else "brand") for k in range(10)], "scan_id long, scope string"
    )
    return lifecycle.backfilled_origin(r, scans).select("repo_id", "origin")
