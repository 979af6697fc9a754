"""Queries of brand matching, rules, secrets, reuse and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import hashing
from siltworks.operators import brands as B
from siltworks.operators import lifecycle, rules, scoring, units
from siltworks.functions import extract
from siltworks.plans.catalog import Tables, query
from siltworks.plans.matching import ENTROPY, brands, context, documents, winnowed

AS_OF = "2024-01-10"
PLACEHOLDER = "(?i)^(?:changeme|password|secret|example|xxxxx*|your[_-]?|dummy|test|todo|fixme|xxx+|sample|placeholder)"
#: The lines' secrets in SQL; of the corpus's shapes only the assignment occurs, which a test makes sure of.
SECRETS = f"""select doc_id, line_number, v from (
  select doc_id, line_number, unnest(regexp_extract_all(line,
    '(?i)(?:api[_-]?key|token|secret|password)\\s*[:=]\\s*[''"]?([^\\s''"]{{8,}})[''"]?', 1)) as v from (
    select doc_id, unnest(l) as line, generate_subscripts(l, 1) as line_number
      from (select doc_id, string_split_regex(text, '\\r?\\n') as l from documents) x) y) z
where length(v) >= 16 and not regexp_matches(v, '{PLACEHOLDER}') and regexp_matches(v, '^[A-Za-z0-9_\\-/.+=]+$')
  and not regexp_matches(v, '^[a-zA-Z]+(\\.[a-zA-Z]+)+$') and {ENTROPY.format(v="v")} >= 3.0"""


def secret_lines(t: Tables):
    lines = units.exploded_lines(documents(t)).where(rules.secret_anchored(F.col("line")))
    return lines.select("repo_id", "line_number", F.posexplode(rules.secret_matches(F.col("line"))).alias("at", "m"))


@query("secret_candidates", "O61", SECRETS.replace("{8,}", "{{8,}}").replace("{{8,}}", "{8,}"))
def _(t):
    return secret_lines(t).select(
        F.col("repo_id").alias("doc_id"),
        F.col("line_number").cast("long").alias("line_number"),
        F.col("m.value").alias("v"),
    )


def corpus_detections(t: Tables):
    """Secrets and contacts of the documents as detections."""
    secret = secret_lines(t).select(
        F.col("repo_id").alias("doc_id"), (F.col("line_number") * 1000 + F.col("at")).cast("long").alias("ord"), F.lit("exposed-secret").alias("rule_id"), F.lit("Exposed Secret").alias("rule_name"),
        F.lit("exposed_secret").alias("category"), F.lit(0.8).alias("confidence"), F.lit(40.0).alias("risk_contribution"),
    )
    contact = t("documents").select("doc_id", F.posexplode(extract.contacts(F.col("text"))).alias("at", "c")).where(
        "c.kind = 'email'"
    )
    return secret.unionByName(contact.select(
        "doc_id", F.col("at").cast("long").alias("ord"), F.lit("contact").alias("rule_id"), F.lit("Contact").alias("rule_name"), F.lit("suspicious_repo").alias("category"),
        F.lit(0.5).alias("confidence"), F.lit(30.0).alias("risk_contribution"),
    ))


@query("severity_counts", "O30 O61 O67 O86 O113 O125", f"""
with s as ({SECRETS}), e as (select doc_id, count(distinct lower(v)) as n
  from (select doc_id, unnest(regexp_extract_all(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}')) as v
  from {{documents}}) x group by doc_id),
p as (select coalesce(c.doc_id, e.doc_id) as doc_id, coalesce(c.n, 0) as ns, coalesce(e.n, 0) as ne
  from (select doc_id, count(*) as n from s group by doc_id) c full join e on e.doc_id = c.doc_id),
z as (select doc_id, list_sum([0] || [floor(36 * pow(0.6,
  r) + 0.5) for r in range(ns)]) + list_sum([0] || [floor(22.5 * pow(0.6, r) + 0.5) for r in range(ne)]) + case
  when ns > 0 and ne > 0 then 5 else 0 end as score from p)
select case when score >= 85 then 'critical' when score >= 65 then 'high' when score >= 40 then 'medium' else 'low' end as severity, count(*) as n, cast(sum(least(100, score)) as bigint) as total from z group by 1""".replace("{2,}", "{2,}"))
def _(t):
    blank = t("documents").select(
        "doc_id", F.lit(0).alias("stars"), F.lit(0).alias("forks"), F.lit(None).cast("timestamp").alias("created_at")
    )
    found = scoring.scores(corpus_detections(t), blank, "doc_id", F.lit(AS_OF).cast("timestamp"))
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


@query("discovery_evidence", "O47", """
select repo_id, case when regexp_matches(full_name, '[a-z0-9]App$') then 'name'
  when regexp_matches(coalesce(description, ''), ' (?i:app) ') then 'description' end as field from {repositories}""")
def _(t):
    e = B.discovery_evidence(
        F.lit("repositories"),
        F.lit(None).cast("string"),
        F.col("full_name"),
        F.col("description"),
        F.expr("cast(array() as array<string>)"),
        F.lit("app"),
    )
    return t("repositories").select("repo_id", e["field"].alias("field"))


@query("credential_reuse", "O62", """
select o_custkey as repo_id, o_orderkey as line_number from {orders} where o_orderkey % 100 in (select p_partkey
  from {part} where p_partkey < 40 and p_partkey % 3 = 0) and o_custkey % 2 = 0""")
def _(t):
    found = t("orders").selectExpr(
        "o_custkey as repo_id",
        "o_custkey % 2 as brand_id",
        "concat('v', o_orderkey % 100) as value",
        "o_orderkey as line_number",
    )
    known = t("part").where("p_partkey < 40 and p_partkey % 3 = 0").select(
        F.lit(0).alias("brand_id"),
        hashing.known_value(F.concat(F.lit("v"), F.col("p_partkey").cast("string"))).alias("value_hash"),
    )
    return rules.credential_reuse(found, known).select("repo_id", "line_number")


@query("file_reuse", "O64", """
select doc_id as repo_id from {documents} d where strlen(text) >= 200 and text in (select text from {documents}
  where doc_id % 5 = 0)""")
def _(t):
    known = t("documents").where("doc_id % 5 = 0").select(hashing.content_hash(F.col("text")).alias("content_hash"))
    return rules.file_reuse(documents(t), known).select("repo_id")


@query("live_destinations", "O65", """
select r.repo_id, 200 + r.repo_id % 400 as status from {repositories} r
  where 200 + r.repo_id % 400 < 500 and r.repo_id in (select finding_id from {detections} where rule_id <> 'rule-4')""")
def _(t):
    d = t("repositories").select(
        "repo_id",
        F.lit("h").alias("hostname"),
        F.concat(F.lit("https://h/"), F.col("repo_id").cast("string")).alias("url"),
        F.lit(1).alias("turn"),
    )
    live = t("repositories").select(
        F.concat(F.lit("https://h/"), F.col("repo_id").cast("string")).alias("url"),
        (200 + F.col("repo_id") % 400).alias("status"),
    )
    found = t("detections").select(
        F.col("finding_id").alias("repo_id"),
        F.expr("if(rule_id = 'rule-4', 'low-reputation-new-repo', rule_id)").alias("rule_id"),
    )
    return rules.live_destinations(d, live, found).select("repo_id", "status")


@query(
    "no_signal",
    "O145",
    """
select count(*) as n from {detections} where finding_id in (select finding_id from {detections}
  where rule_id <> 'rule-4')""",
)
def _(t):
    found = t("detections").select(
        F.col("finding_id").alias("repo_id"),
        F.expr("if(rule_id = 'rule-4', 'low-reputation-new-repo', rule_id)").alias("rule_id"),
    )
    return lifecycle.has_signal(found).agg(F.count("*").alias("n"))


@query("reference_summary", "O118", """
select 'owner' || (doc_id % 5) as owner, count(*) as files, cast(max(doc_id) as bigint) as last_doc, arg_max(lang,
  doc_id) as last_lang from {documents} group by 1""")
def _(t):
    rows = t("documents").withColumn("owner", F.concat(F.lit("owner"), (F.col("doc_id") % 5).cast("string")))
    return rows.groupBy("owner").agg(
        F.count("*").alias("files"), F.max("doc_id").alias("last_doc"), F.max_by("lang", "doc_id").alias("last_lang")
    ).orderBy("owner")


