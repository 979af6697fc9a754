"""Queries of the rules, each by itself and together, over repositories of which some set off each rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions import constants as K
from siltworks.functions import hashing
from siltworks.operators import rules
from siltworks.plans.catalog import Tables, query
from siltworks.plans.matching import brands

AS_OF = "2024-01-10"


def context(t: Tables) -> DataFrame:
    """The context table of the view `suspects`."""
    none = "cast(array() as array<{}>)"
    rows = t("suspects").join(brands(t), "brand_id", "left")
    brand = F.struct(F.col("brand_name").alias("name"), "aliases", "keywords", "trusted_owners")
    file = "array(named_struct('path', 'src/run.py', 'content', code))"
    return rows.withColumns({
        "name": F.element_at(F.split("full_name", "/"), -1),
        "topics": F.expr(none.format("string")),
        "readme_path": F.lit("README.md"),
        "file_paths": F.split("paths", ","),
        "files": F.expr(f"if(code is null, {none.format('struct<path:string,content:string>')}, {file})"),
        "brand": F.when(F.col("brand_name").isNotNull(), brand),
    })


def detections(t: Tables, **options) -> DataFrame:
    """What the rules find in the context, with the keyword alone as evidence of a keyword's match."""
    found = rules.analysed(context(t), F.lit(AS_OF).cast("timestamp"), **options)
    shown = F.when(F.col("rule_id") == "custom-keyword-match", F.split_part("evidence", F.lit(": "), F.lit(1)))
    return found.select(
        "repo_id",
        "rule_id",
        "severity",
        F.round("confidence", 6).alias("confidence"),
        "risk_contribution",
        shown.otherwise(F.col("evidence")).alias("evidence"),
        "file",
        F.col("line_number").cast("long").alias("line_number"),
    )


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _within(values, text: str = "t") -> str:
    return f"[x for x in {_list(values)} if contains({text}, x)]"


#: The context in SQL: `base`, a row a repository, and `units`, its texts in order.
BASE = """
with base0 as (
  select s.*, b.brand_name, b.keywords, b.aliases, string_split(s.paths, ',') as files,
    case when b.brand_name is null then cast([] as varchar[]) else [lower(b.brand_name)] || string_split(b.aliases,
      ',') end as names,
    lower(concat_ws(' ', s.full_name, s.description, s.readme_text, replace(s.paths, ',', ' '), s.code)) as t,
    coalesce(epoch(timestamp '2024-01-10' - s.created_at) / 86400, 999) as age,
    coalesce(epoch(timestamp '2024-01-10' - s.owner_created_at) / 86400 <= 30, false) as new_owner
  from {suspects} s left join {brands} b on b.brand_id = s.brand_id
), base as (
  select *, len([a for a in names if contains(t, a)]) > 0 as branded, regexp_matches(paths, '(?i)\\.apk(,|$)') as apk
    from base0
), units as (
  select * from (
    select repo_id, names, 0 as rank, 0 as entry, 0 as line, full_name as text, cast(null as varchar) as path from base
    union all select repo_id, names, 1, 0, 0, description, null from base
    union all select repo_id, names, 3, unnest(range(len(files))), 0, unnest(files), null from base
    union all select repo_id, names, 4, 0, unnest(range(1, len(l) + 1)), unnest(l), 'README.md'
      from (select *, string_split_regex(readme_text, '\\r?\\n') as l from base) x
    union all select repo_id, names, 5, 1, unnest(range(1, len(l) + 1)), unnest(l), 'src/run.py'
      from (select *, string_split_regex(code, '\\r?\\n') as l from base where code is not null) x
  ) y where length(text) > 0
)"""

COLUMNS = "repo_id, rule_id, severity, confidence, risk_contribution, evidence, file, line_number"

RULE_SQL = {
    "brand-impersonation": ("O50", f"""
select h.repo_id, 'brand-impersonation' as rule_id, case when n >= 3 then 'high' else 'medium' end as severity,
  round(least(0.9, 0.55 + n * 0.1), 6) as confidence,
  20 + least(15, n * 4) as risk_contribution, b.brand_name || ': ' || array_to_string(terms[1:5], ', ') as evidence,
    best.path as file, case when best.line > 0 then best.line end as line_number
from (
  select repo_id, list(x order by place, k) as terms, count(*) as n from (
    select repo_id, x, min(place) as place, arg_min(k, place) as k from (
      select repo_id, unnest(terms) as x, unnest(range(len(terms))) as k, rank * 1e9 + entry * 1e6 + line as place
        from hits) a
    group by repo_id, x) b group by repo_id) h
join (select repo_id, arg_min(struct_pack(path := path, line := line),
  -len(terms) * 1e12 + rank * 1e9 + entry * 1e6 + line) as best from hits group by repo_id) p on p.repo_id = h.repo_id
join base b on b.repo_id = h.repo_id
where not (((len([x for x in terms if not list_contains({_list(K.WEAK_SUSPICIOUS_KEYWORDS)}, x)]) = 0)
  or lower(b.owner) = replace(lower(b.brand_name), ' ', '') or b.stars >= 500) and n < 2)"""),
    "phishing-kit": ("O51", f"""
select repo_id, 'phishing-kit', case when n + cast(branded as int) >= 2 then 'critical' else 'high' end,
  round(least(0.92, 0.6 + (n + cast(branded as int)) * 0.1), 6),
  25 + least(20, (n + cast(branded as int)) * 6), array_to_string(h, ', '), null, null
from (select *, len(h) as n from (select *, {_within(K.PHISHING_TERMS)} as h from base) x) y
where n > 0 and not (len([x for x in h if not list_contains({_list(K.WEAK_PHISHING_TERMS)}, x)]) = 0 and not branded
  and n < 2)"""),
    "fake-apk": ("O52", f"""
select repo_id, 'fake-apk', case when apk then 'critical' else 'high' end, case when apk then 0.9 else 0.75 end, case
  when apk then 32 else 24 end, array_to_string(h, ', '), null, null
from (select *, {_within(K.APK_HINTS)} as h from base) x where branded and (len(h) > 0 or apk)"""),
    "malware-indicators": ("O53", f"""
select repo_id, 'malware-indicators', case when len(h) + len(w) >= 2 or scripted then 'critical' else 'high' end, 0.7,
  28 + least(12, (len(h) + len(w)) * 4), array_to_string(h || w, ', '), null, null
from (select *, {_within(K.MALWARE_TERMS)} as h, {_within(K.WEAK_MALWARE_TERMS)} as w,
  regexp_matches(paths, '(?i)\\.(ps1|bat|cmd|vbs|exe|dll|scr)(,|$)') and (contains(t, 'crack') or contains(t, 'bypass')
    or contains(t, 'payload')) as scripted from base) x
where len(h) > 0 or scripted"""),
    "low-reputation-new-repo": ("O54", """
select repo_id, 'low-reputation-new-repo', 'low', 0.55, case when age <= 30 and stars <= 2 then 12 else 8 end,
  'stars ' || stars, null, null
from base where branded and (age <= 30 or stars <= 2)"""),
    "suspicious-owner-account": ("O55", """
select repo_id, 'suspicious-owner-account', case when new_owner and idle then 'medium' else 'low' end, case
  when new_owner and idle then 0.7 else 0.5 end, case when new_owner and idle then 14 else 8 end, owner, null, null
from (select *, coalesce(followers <= 0 and public_repos <= 1, false) as idle from base) x
where branded and coalesce(cast(owner_created_at as varchar), cast(followers as varchar),
  cast(public_repos as varchar)) is not null and (new_owner or idle)"""),
    "disposable-phishing-repo": ("O56", f"""
select repo_id, 'disposable-phishing-repo', 'high', round(least(0.95, 0.75 + k * 0.07), 6), 15, k || ' intent signals',
  null, null
from (select *, cast(len({_within(K.PHISHING_TERMS)}) > 0 as int) + cast(len({_within(K.APK_HINTS)}) > 0
  or apk as int) + cast(len({_within(K.SUSPICIOUS_KEYWORDS)}) > 0 as int) as k from base) x
where branded and stars = 0 and forks = 0 and not is_fork and age <= 14 and k > 0"""),
    "obfuscated-commands": ("O57", f"""
select repo_id, 'obfuscated-commands', 'high', 0.8, 22, f.path || ':' || f.line, f.path, f.line
from (select repo_id, arg_min(struct_pack(path := path, line := line), case when rank = 5 then 0
  else 1e12 end + entry * 1e6 + line) as f from units
  where line > 0 and regexp_matches(text,
    '(?i)powershell\\s+-enc\\s+|eval\\s*\\(\\s*atob\\s*\\(|base64\\s+-d\\s*\\|\\s*(?:sh|bash|zsh|python3?|perl|ruby|node|powershell)\\b|\\[system\\.convert\\]::frombase64string')
  group by repo_id) x"""),
    "custom-keyword-match": ("O58", """
select repo_id, 'custom-keyword-match', case when rank <= 3 then 'medium' else 'low' end, case when rank <= 3 then 0.75
  else 0.6 end, case when rank <= 3 then 18 else 12 end, kw, path, case when line > 0 then line end
from (
  select u.*, kw, row_number() over (partition by u.repo_id, kw order by rank, entry, line) as turn from units u
  join (select repo_id, unnest([trim(k) for k in string_split(keywords, ',') if trim(k) <> ''
    and not list_contains(names, lower(trim(k)))]) as kw from base where brand_name is not null) k
    on k.repo_id = u.repo_id and (regexp_matches(u.text, '(^|[^A-Za-z0-9])(?i:' || kw || ')($|[^a-z0-9])')
      or regexp_matches(u.text, '[a-z0-9]' || upper(kw[1]) || '(?i:' || kw[2:] || ')($|[^a-z0-9])'))
) x where turn = 1"""),
    "suspicious-destination": ("O59", f"""
select repo_id, 'suspicious-destination', 'high', 0.7, 25, 'sends data to ' || host, path, null
from (
  select *, row_number() over (partition by repo_id order by place) as turn from (
    select repo_id, host, min(place) as place, arg_min(path, place) as path from (
      select repo_id, path, names, own, place, lower(regexp_extract(url, '^(?i:https?)://([^/?#]+)', 1)) as host from (
        select repo_id, names, own, path, base_place + 1000000 * p + unnest(range(len(hits))) as place,
          unnest(hits) as url from (
          select repo_id, names, own, path, base_place, p, regexp_extract_all(content, pattern, 1) as hits from (
            select repo_id, names, string_split(lower(aliases || ',' || keywords), ',') as own, 'README.md' as path,
              readme_text as content, 0 as base_place from base where brand_name is not null
            union all select repo_id, names, string_split(lower(aliases || ',' || keywords), ','), 'src/run.py', code,
              100000000 from base where brand_name is not null and code is not null) f,
          (values (0, '{K.DESTINATIONS[0].replace("'", "''")}'), (1, '{K.DESTINATIONS[1].replace("'", "''")}'), (2,
            '{K.DESTINATIONS[2].replace("'", "''")}')) pt(p, pattern)
        ) h
      ) u where regexp_matches(url, '(?i)^https?://')
    ) v
    where not list_contains({_list(K.BENIGN_HOSTS)}, host) and not list_contains(own, host)
      and not list_has_any([regexp_replace(x, '[^a-z0-9]', '', 'g') for x in string_split(host, '.')],
        [regexp_replace(a, '[^a-z0-9]', '', 'g') for a in names if length(regexp_replace(a, '[^a-z0-9]', '',
        'g')) >= 4])
    group by repo_id, host) w
) z where turn <= 5"""),
    "deployment-signal": ("O60", f"""
select repo_id, 'deployment-signal', 'low', 0.5, 8, array_to_string(found, ', '), null, null
from (select *, [c for c in {_list(K.DEPLOY_CONFIGS)} if len([p for p in files if p = c or suffix(p,
  '/' || c)]) > 0] as found from base) x
where brand_name is not null and len(found) > 0"""),
}
HITS = f""", hits as (
  select * from (select repo_id, rank, entry, line, path,
    [x for x in {_list(K.SUSPICIOUS_KEYWORDS)} if regexp_matches(lower(text),
    '(?:^|[^a-z0-9])' || x || '(?:$|[^a-z0-9])')] as terms
    from units where len([a for a in names if regexp_matches(lower(text),
      '(?:^|[^a-z0-9])' || a || '(?:$|[^a-z0-9])')]) > 0) x where len(terms) > 0
)"""
TYPES = """cast(risk_contribution as double) as risk_contribution, evidence, file, cast(line_number as bigint) as line_number"""


def twin(identities) -> str:
    """What these rules find, in SQL; `found` has the columns of detections()."""
    every = "\nunion all\n".join(f"select * from ({RULE_SQL[i][1]}) as r({COLUMNS})" for i in identities)
    return f"""{BASE}{HITS}, found as (
select repo_id, rule_id, severity, cast(confidence as double) as confidence, {TYPES} from ({every}) e)
"""


def _rule(identity: str):
    @query(
        "rule_" + identity.replace("-", "_"), RULE_SQL[identity][0], twin([identity]) + f"select {COLUMNS} from found"
    )
    def _(t):
        return detections(t, excluded=tuple(r for r in rules.RULES if r != identity))


for _identity in RULE_SQL:
    _rule(_identity)

assert list(RULE_SQL) == list(rules.RULES)


@query(
    "rule_detections",
    "O50 O51 O52 O53 O54 O55 O56 O57 O58 O59 O60 O66",
    twin(RULE_SQL) + f"select {COLUMNS} from found",
)
def _(t):
    return detections(t)


AUDITED = [r for r in RULE_SQL if r not in K.IMPERSONATION_ONLY_RULES]


@query("internal_audit_rules", "O28", twin(AUDITED) + f"select {COLUMNS} from found")
def _(t):
    return detections(t, internal_audit=True)


@query("branch_analysis", "O168", twin(RULE_SQL) + """
select repo_id, substr(sha256(repo_id || ':dev:' || string_agg(rule_id, ',' order by rule_id)), 1, 32) as key from found
  group by repo_id""")
def _(t):
    found = detections(t).groupBy("repo_id").agg(F.collect_list("rule_id").alias("r"))
    return found.select("repo_id", hashing.finding_key(F.col("repo_id"), F.col("r"), F.lit("dev")).alias("key"))


@query("ruleset_version", "O66", f"select substr(sha256('1:{','.join(sorted(rules.RULES))}'), 1, 16) as version")
def _(t):
    return t.spark.range(1).select(rules.ruleset_version().alias("version"))
