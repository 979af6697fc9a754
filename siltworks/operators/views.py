"""Filtered, joined and aggregated views of repositories and findings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import constants as K
from siltworks.functions.text import quoted
from siltworks.operators.scoring import half_up

CLASS_CATEGORIES = {"credential_exposure": K.CREDENTIAL_CATEGORIES, "malicious_intent": K.INTENT_CATEGORIES}
SORTS = ("created_at", "risk_score", "severity", "last_seen_at")


def is_not(column: Column, value) -> Column:
    """Inequality that a missing value fulfils."""
    return ~column.eqNullSafe(F.lit(value))


def between(column: Column, start=None, stop=None) -> Column:
    """Both bounds count; without bounds all rows pass, a missing value only then."""
    ok = F.lit(True)
    for bound, test in ((start, lambda b: column >= b), (stop, lambda b: column <= b)):
        if bound is not None:
            ok = ok & test(F.lit(bound).cast("timestamp_ntz"))
    return ok


def category_filter(categories: Column, category: str | None, threat_class: str | None) -> Column:
    """A category, if of the class asked for, or any of the class; both given without overlap match nothing."""
    members = CLASS_CATEGORIES.get(threat_class or "", ())
    if category and threat_class:
        return F.array_contains(categories, category) if category in members else F.lit(False)
    if category:
        return F.array_contains(categories, category)
    return F.arrays_overlap(categories, F.array(*map(F.lit, members))) if threat_class else F.lit(True)


def findings_filter(
    findings: DataFrame,
    *,
    equal: dict | None = None,
    category=None,
    threat_class=None,
    brand=None,
    search=None,
    start=None,
    stop=None,
) -> DataFrame:
    """All conditions that are given; brand and search are regular expressions without regard to case."""
    ok = F.lit(True)
    for column, value in (equal or {}).items():
        if value is not None:
            ok = ok & (F.col(column) == F.lit(value))
    ok = ok & category_filter(F.col("categories"), category, threat_class) & between(F.col("created_at"), start, stop)
    if brand:
        ok = ok & F.col("brand_name").rlike(f"(?i){brand}")
    if search:
        ok = ok & (F.col("summary").rlike(f"(?i){search}") | F.col("brand_name").rlike(f"(?i){search}"))
    return findings.where(ok)


def repositories_filter(
    repos: DataFrame,
    *,
    pending=None,
    name=None,
    brand_id=None,
    language=None,
    created=(None, None),
    pushed=(None, None),
) -> DataFrame:
    """External repositories; name is a regular expression, language is compared as text without regard to case."""
    ok = F.col("origin") == "external"
    if pending is not None:
        ok = ok & (F.col("pending_analysis") == pending)
    if name:
        ok = ok & F.col("full_name").rlike(f"(?i){name}")
    if brand_id is not None:
        ok = ok & (F.col("brand_id") == brand_id)
    if language:
        ok = ok & F.col("language").rlike(f"(?i)^{quoted(language)}$")
    return repos.where(ok & between(F.col("created_at"), *created) & between(F.col("pushed_at"), *pushed))


def deployed(column: Column, wanted: bool | None) -> Column:
    return F.lit(True) if wanted is None else column.isNotNull() if wanted else column.isNull()


def sorted_by(rows: DataFrame, column: str | None, order: str | None, key: str) -> DataFrame:
    """By a known column, else by creation; descending unless asked otherwise. Severity sorts as text."""
    c = F.col(column if column in SORTS and column in rows.columns else "created_at")
    return rows.orderBy(c.asc() if order == "asc" else c.desc(), key)


def page(rows: DataFrame, number: int = 1, size: int = 20, most: int = 100) -> DataFrame:
    size = max(1, min(size, most))
    return rows.offset((max(1, number) - 1) * size).limit(size)


def page_envelope(total: int, number: int, size: int) -> dict:
    return {"total": total, "page": number, "limit": size, "pages": math.ceil(total / size)}


def eligible_findings(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings of repositories whose analysis isn't pending."""
    return findings.join(repos.where("not pending_analysis").select("repo_id"), "repo_id", "left_semi")


def located(repos: DataFrame, findings: DataFrame, location: str) -> DataFrame:
    """repos with a finding at a location, or without any finding and discovered there."""
    flags = findings.groupBy("repo_id").agg(F.max((F.col("match_location") == location).cast("int")).alias("_here"))
    rows = repos.join(flags, "repo_id", "left")
    return rows.where((F.col("_here") == 1) | (F.col("_here").isNull() & (F.col("discovery_field") == location))).drop(
        "_here"
    )


def unseen(items: DataFrame, seen: DataFrame, key: str = "repo_id") -> DataFrame:
    return items.join(seen.select(key).distinct(), key, "left_anti")


def linked_identities(identities: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (repo_id, kind, value, other_repo, other_owner) of repositories that share an identity.

    For a common value this has as many rows as pairs, as such a view must; counts alone are
    better got from linked_owner_counts, which makes no pairs of an owner's largest group.
    """
    by = by or ["workspace_id", "kind", "value"]
    other = identities.select(*by, F.col("repo_id").alias("other_repo"), F.col("owner").alias("other_owner"))
    return identities.join(other, by).where("repo_id <> other_repo").select(
        "repo_id", "kind", "value", "other_repo", "other_owner"
    )


def linked_owner_counts(identities: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows (workspace_id, owner, linked_owners): other owners with an equal identity whose repositories have a finding that isn't false.

    Of an owner's identities the commonest is only counted: its group's size, less the owner.
    Owners of the other identities are paired, and those who are in the commonest's group as
    well don't count again. So a value that many owners have makes no pairs unless they have
    a still commoner one.
    """
    by = ["workspace_id", "kind", "value"]
    real = findings.where(is_not(F.col("status"), "false_positive")).select("repo_id").distinct()
    members = identities.join(real, "repo_id", "left_semi").where("owner is not null").select(
        *by, F.col("owner").alias("other")
    ).distinct()
    sizes = members.groupBy(*by).agg(F.count("*").alias("n"))
    mine = identities.where("owner is not null").select(*by, "owner").distinct().join(sizes, by)
    top = F.max(F.struct("n", "kind", "value")).alias("top")
    top = mine.groupBy("workspace_id", "owner").agg(top).select(
        "workspace_id", "owner", "top.n", F.col("top.kind").alias("_k"), F.col("top.value").alias("_v")
    )
    inside = members.select(
        "workspace_id",
        F.col("kind").alias("_k"),
        F.col("value").alias("_v"),
        F.col("other").alias("owner"),
        F.lit(1).alias("_in"),
    )
    base = top.join(inside, ["workspace_id", "_k", "_v", "owner"], "left")
    base = base.select("workspace_id", "owner", (F.col("n") - F.coalesce("_in", F.lit(0))).alias("linked"))
    rest = mine.drop("n").join(top.drop("n"), ["workspace_id", "owner"]).where("kind <> _k or value <> _v")
    rest = rest.join(members, by).where("owner <> other").select(
        "workspace_id", "owner", "other", "_k", "_v"
    ).distinct()
    rest = rest.join(
        inside.select("workspace_id", "_k", "_v", F.col("owner").alias("other")),
        ["workspace_id", "_k", "_v", "other"],
        "left_anti",
    )
    rest = rest.groupBy("workspace_id", "owner").agg(F.count("*").alias("more"))
    both = base.join(rest, ["workspace_id", "owner"], "left").withColumn(
        "linked_owners", F.col("linked") + F.coalesce("more", F.lit(0))
    )
    return both.where("linked_owners > 0").select("workspace_id", "owner", "linked_owners")


def shared_contributors(contributors: DataFrame, repos: DataFrame) -> DataFrame:
    """contributors with the names of each login's other repositories, joined by commas in the order of their ids.

    The lists are what the view shows, so a login's lists grow with the square of its
    repositories; contributor_overlap counts without them. Each login's names are joined once,
    and a row gets the bytes before and after its own repository's name.
    """
    named = contributors.join(repos.where("full_name is not null").select("repo_id", "full_name"), "repo_id").groupBy(
        "login", "repo_id"
    ).agg(F.array_join(F.array_sort(F.collect_set("full_name")), ",").alias("_part"))
    size = F.octet_length("_part")
    upto = F.sum(size + 1).over(Window.partitionBy("login").orderBy("repo_id"))
    at = named.select("login", "repo_id", size.alias("_size"), (upto - size - 1).cast("int").alias("_at"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("repo_id", "_part"))), lambda r: r["_part"])
    whole = named.groupBy("login").agg(F.array_join(parts, ",").cast("binary").alias("_all"))
    rows = contributors.join(at, ["login", "repo_id"], "left").join(whole, "login", "left")
    after = F.col("_at") + F.col("_size") + 2  # the first byte, from 1 on, behind the name and its comma
    end = F.octet_length("_all")
    others = (
        F.when(F.col("repo_id").isNull() | F.col("_all").isNull(), F.lit(b""))
        .when(F.col("_at").isNull(), F.col("_all"))
        .when(after > end + 1, F.substring("_all", F.lit(1), F.greatest(F.col("_at") - 1, F.lit(0))))
        .otherwise(F.concat(F.substring("_all", F.lit(1), F.col("_at")), F.substring("_all", after, end)))
    )
    return rows.select("repo_id", "login", "contributions", others.cast("string").alias("others"))


def contributor_overlap(contributors: DataFrame) -> DataFrame:
    """Rows (repo_id, shared): how many of a repository's people contribute elsewhere."""
    wide = contributors.groupBy("login").agg(F.countDistinct("repo_id").alias("n")).where("n > 1")
    rows = contributors.join(wide.select("login"), "login", "left_semi")
    return rows.groupBy("repo_id").agg(F.countDistinct("login").alias("shared"))


def repeat_operators(repos: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows (repo_id, other_brands): brands that findings of the owner's other repositories name."""
    real = findings.where(is_not(F.col("status"), "false_positive") & (F.length("brand_name") > 0))
    brands = repos.select("repo_id", "workspace_id", "owner").join(
        real.select("repo_id", "brand_name").distinct(), "repo_id"
    )
    # a brand counts for a repository if another one of the owner has it: two repositories with it tell
    seen = brands.groupBy("workspace_id", "owner", "brand_name").agg(
        F.min("repo_id").alias("a"), F.max("repo_id").alias("b")
    )
    rows = repos.select("repo_id", "workspace_id", "owner").join(seen, ["workspace_id", "owner"])
    return rows.where("a <> repo_id or b <> repo_id").groupBy("repo_id").agg(F.count("*").alias("other_brands"))


def match_info(repos: DataFrame, findings: DataFrame, brands: DataFrame) -> DataFrame:
    """repos with the riskiest finding, and the brand of it or else that of the discovery."""
    top = top_per_repository(findings).select(
        "repo_id", "finding_id", "risk_score", F.col("brand_name").alias("_found")
    )
    rows = repos.join(top, "repo_id", "left").join(
        brands.select("brand_id", F.col("brand_name").alias("_brand")), "brand_id", "left"
    )
    name = F.coalesce(F.when(F.length("_found") > 0, F.col("_found")), "_brand", F.lit("unknown"))
    return rows.select(
        "repo_id",
        "finding_id",
        "risk_score",
        name.alias("matched_brand"),
        F.col("finding_id").isNotNull().alias("confirmed"),
    )


def top_per_repository(findings: DataFrame) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("risk_score"), "finding_id"))
    return findings.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def rule_precision(detections: DataFrame, findings: DataFrame) -> DataFrame:
    """Rows (rule_id, rule_name, findings, false_positives, rate): a finding counts once a rule."""
    once = detections.groupBy("rule_id", "finding_id").agg(F.max("rule_name").alias("rule_name"))
    rows = once.join(findings.select("finding_id", "status"), "finding_id")
    out = rows.groupBy("rule_id").agg(
        F.max("rule_name").alias("rule_name"), F.count("*").alias("findings"), F.sum(F.when(F.col("status") == "false_positive", 1).otherwise(0)).alias("false_positives")
    )
    rate = half_up(F.col("false_positives") / F.col("findings") * 100) / 100
    return out.withColumn("rate", rate).orderBy(F.desc("findings"), "rule_id")


def latest(rows: DataFrame, key: list[str] | str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    key = [key] if isinstance(key, str) else key
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return last.select("_r.*")


def active_by_keyword(scans: DataFrame) -> DataFrame:
    """Rows (keyword, found, analysed, scan_id, status): sums over a keyword's scans, and its last scan."""
    return scans.groupBy("keyword").agg(
        F.sum(F.coalesce("found", F.lit(0))).alias("found"), F.sum(F.coalesce("analysed", F.lit(0))).alias("analysed"),
        F.max("scan_id").alias("scan_id"), F.max_by("status", "scan_id").alias("status"),
    )


def daily_histogram(rows: DataFrame, at: str, days: int = 30) -> DataFrame:
    """Counts by UTC day, the oldest days first and only."""
    return rows.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy("day").limit(
        days
    )


def dashboard(findings: DataFrame, repos: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of counts."""
    f = findings.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )
    r = repos.agg(F.count("*").alias("repositories"))
    a = alerts.agg(F.count_if(~F.col("read")).alias("unread"))
    return f.join(r, F.lit(True)).join(a, F.lit(True))


def top_phrases(phrases: DataFrame, each: int, whole: int = 500) -> DataFrame:
    """The first phrases of each brand among the wordiest of all."""
    some = phrases.orderBy(F.desc("significant_words"), "phrase_id").limit(whole)
    turn = F.row_number().over(Window.partitionBy("brand_id").orderBy(F.desc("significant_words"), "phrase_id"))
    return some.withColumn("turn", turn).where(F.col("turn") <= each)


def top_keywords(keywords: DataFrame, each: int = 5) -> DataFrame:
    """The first enabled keywords of each category by priority, then by name."""
    turn = F.row_number().over(
        Window.partitionBy("category").orderBy(F.desc("priority"), F.lower("keyword"), "keyword")
    )
    return keywords.where("enabled").withColumn("turn", turn).where(F.col("turn") <= each)


def recent_changes(repos: DataFrame, findings: DataFrame, since, pushes: int = 8, changes: int = 8) -> DataFrame:
    """Last pushes, and last new or reopened findings; those whose repository is missing go after the limit."""
    start = F.lit(since).cast("timestamp_ntz")
    pushed = repos.where(F.col("pushed_at") >= start).orderBy(F.desc("pushed_at"), "repo_id").limit(min(pushes, 200))
    changed = findings.where(
        (F.col("created_at") >= start) & F.col("last_change_type").isin("new", "reopened")
    ).orderBy(F.desc("created_at"), "finding_id").limit(min(changes, 200))
    changed = changed.join(repos.select("repo_id", "full_name"), "repo_id")
    return pushed.select(F.lit("push").alias("kind"), "repo_id", "full_name", F.col("pushed_at").alias("at")).unionByName(
        changed.select(F.col("last_change_type").alias("kind"), "repo_id", "full_name", F.col("created_at").alias("at"))
    )


def contributor_rollup(contributors: DataFrame, repos: DataFrame, least: int = 2) -> DataFrame:
    """Rows (login, repos, owners) of people in `least` repositories or more."""
    rows = contributors.join(repos.select("repo_id", "owner"), "repo_id").groupBy("login").agg(
        F.countDistinct("repo_id").alias("repos"), F.countDistinct("owner").alias("owners")
    )
    return rows.where(F.col("repos") >= least)


def finding_detail(finding: DataFrame, repos: DataFrame, detections: DataFrame) -> DataFrame:
    """findings with their repository's name and an array of their detections in order."""
    items = detections.groupBy("finding_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "rule_id", "severity"))).alias("detections")
    )
    return finding.join(repos.select("repo_id", "full_name", "owner"), "repo_id", "left").join(
        items, "finding_id", "left"
    )


def slots_known(slots: DataFrame, brands: DataFrame) -> DataFrame:
    """slots(brand_id, keyword) with known: whether the brand has the keyword, without regard to case."""
    rows = slots.join(
        brands.select("brand_id", F.transform("keywords", lambda k: F.lower(k)).alias("_k")), "brand_id", "left"
    )
    return rows.withColumn("known", F.coalesce(F.array_contains("_k", F.lower("keyword")), F.lit(False))).drop("_k")


def quota_status(snapshots: DataFrame, used: DataFrame, budget: int, low: int = 50) -> DataFrame:
    """Rows of each resource's last snapshot with flags and warnings."""
    last = latest(snapshots, ["workspace_id", "resource"], ["at"]).join(used, "workspace_id", "left")
    left = F.lit(budget) - F.coalesce("used", F.lit(0))
    is_low, is_spent = F.col("remaining") <= low, left <= math.ceil(budget / 10)
    warnings = F.array_compact(
        F.array(
            F.when(is_low, F.concat(F.lit("low quota: "), "resource")),
            F.when(is_spent, F.lit("daily budget nearly spent")),
        )
    )
    return last.select(
        "workspace_id",
        "resource",
        "remaining",
        is_low.alias("low"),
        is_spent.alias("spent"),
        F.array_join(warnings, "; ").alias("warnings"),
    )


def commit_search_url(base: str, login: Column) -> Column:
    return F.concat(F.lit(f"{base}/search?q="), F.url_encode(F.concat(F.lit("author:"), login)), F.lit("&type=commits"))
