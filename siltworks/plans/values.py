"""Queries whose SQL works their values out anew, over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from siltworks.functions import constants as K
from siltworks.functions import dates, extract, hashing, paths
from siltworks.functions import text as T
from siltworks.operators import brands as B
from siltworks.operators import intent, lifecycle, rotation, rules, scoring, units, views
from siltworks.plans import discovery, suspects
from siltworks.plans.catalog import query
from siltworks.plans.matching import WORDS, brands, documents, patches, winnowed
from siltworks.plans.streams import requests
from siltworks.plans.suspects import BASE
from siltworks.sources import repos as source
from siltworks.streaming import progress

LINES = """select doc_id, unnest(l) as line, unnest(range(1, len(l) + 1)) as line_number
  from (select doc_id, string_split_regex(text, '\\r?\\n') as l from {documents}) x"""


# --- similarity -------------------------------------------------------------------------------------------------

#: Steps that walk through a's characters and take the first free equal one of b's within reach, then the formula.
JARO = """
walk(a, b, i, free, mine) as (
  select a, b, 1, string_split(b, ''), cast([] as varchar[]) from pairs
  union all
  select a, b, i + 1, case when j is null then free else [case when x = j then '' else free[x] end for x in range(1,
    len(free) + 1)] end,
    case when j is null then mine else list_append(mine, a[i]) end
  from (select *, [x for x in range(greatest(1, i - reach), least(length(b), i + reach) + 1) if free[x] = a[i]][1] as j
    from (select *, greatest(length(a), length(b)) // 2 - 1 as reach from walk where i <= length(a)) w) v
), matched as (
  select a, b, mine, len(mine) as m, [b[x] for x in range(1, length(b) + 1) if free[x] = ''] as theirs, least(4,
    length(a), length(b)) as most
  from walk where i > length(a)
), jaro as (
  select a, b, case when m = 0 then 0 else (m / length(a) + m / length(b) + (m - len([k for k in range(1,
    m + 1) if mine[k] <> theirs[k]]) / 2) / m) / 3 end as j,
    coalesce([k for k in range(1, most + 1) if a[k] <> b[k]][1] - 1, most) as prefix from matched
), alike as (select a, b, case when j = 0 then 0 else j + prefix * 0.1 * (1 - j) end as similarity from jaro)
"""


@query("jaro_winkler", "O37", """
with recursive w as (select distinct unnest(string_split(p_name, ' ')) as a from {part}),
pairs as (select x.a, y.a as b from w x join w y on x.a < y.a),""" + JARO + "select a, b, round(similarity, 9) as similarity from alike")
def _(t):
    p = t("part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct()
    pairs = p.join(p.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(T.jaro_winkler("a", "b"), 9).alias("similarity"))


@query("fuzzy_pairs", "O38 O110", f"""
with recursive pairs as (select distinct w as a, x as b
  from (select unnest({WORDS.format(t="full_name || ' ' || coalesce(description, '')")}) as w from {{repositories}}) t,
  (select unnest(string_split(lower(aliases), ',') || [lower(brand_name)]) as x from {{brands}}) n
    where abs(length(w) - length(x)) <= 2),"""
  + JARO + "select a as token, b as alias, round(similarity, 9) as similarity from alike where similarity >= 0.85")
def _(t):
    text = F.concat_ws(" ", "full_name", "description")
    words = t("repositories").select(F.explode(T.tokens(text)).alias("token"))
    names = F.concat(F.split(F.lower("aliases"), ","), F.array(F.lower("brand_name")))
    pairs = T.fuzzy_pairs(words, t("brands").select(F.explode(names).alias("alias")))
    return pairs.withColumn("similarity", F.round("similarity", 9))


# --- brands and keywords ----------------------------------------------------------------------------------------

#: Whether a text has a term as a word, or as a part of a name in camel case.
WORD = "(contains(lower({u}), lower({k})) and (regexp_matches({u}, '(^|[^A-Za-z0-9])(?i:' || {k} || ')($|[^a-z0-9])') or regexp_matches({u}, '[a-z0-9]' || upper({k}[1]) || '(?i:' || {k}[2:] || ')($|[^a-z0-9])')))"
PROOFS = f"""
, names as (select brand_id, unnest(n) as a, unnest(range(len(n))) as k
  from (select brand_id, [lower(brand_name)] || string_split(aliases, ',') as n from {{brands}}) x),
owned as (select s.repo_id, b.brand_id, -1 as rank, 0 as entry, 0 as line, lower(s.owner) as alias
  from base s join {{brands}} b on list_contains(string_split(lower(b.trusted_owners), ','), lower(s.owner))),
exact as (
  select repo_id, brand_id, rank, entry, line, a as alias from units u join names on {WORD.format(u="u.text", k="a")}
  qualify row_number() over (partition by repo_id, brand_id order by rank, entry, line, k) = 1
), sure as (
  select *, 3 as strength from owned union all
  select *, 2 from exact where (repo_id, brand_id) not in (select (repo_id, brand_id) from owned)
)"""
BEST = """
select repo_id, brand_id, case strength when 3 then 'trusted_owner' when 2 then 'exact' else 'fuzzy' end as type, rank,
  line as line_number, alias
from proofs qualify row_number() over (partition by repo_id order by rank <= 3 desc, strength desc, brand_id) = 1"""


def best_brands(t, exact_only: bool):
    c = suspects.context(t)
    proofs = B.evidence(units.text_units(c), c, brands(t), exact_only=exact_only)
    return B.best_brand(proofs, t("brands")).select("repo_id", "brand_id", "type", "rank", "line_number", "alias")


@query("trusted_and_exact_brand", "O39 O43", BASE + PROOFS + ", proofs as (select * from sure)" + BEST)
def _(t):
    return best_brands(t, exact_only=True)


@query("brand_evidence", "O38 O39 O43", BASE.replace("with base0", "with recursive base0") + PROOFS + f""",
tokens as (select repo_id, rank, entry, line, unnest(w) as token, unnest(range(len(w))) as k
  from (select *, string_split_regex(lower(text), '[^a-z0-9]+') as w from units) x),
pairs as (select distinct token as a, n.a as b from (select distinct token from tokens
  where length(token) >= 3) t, names n where abs(length(token) - length(n.a)) <= 2),
{JARO},
fuzzy as (
  select t.repo_id, n.brand_id, t.rank, t.entry, t.line, n.a as alias from tokens t
    join alike s on s.a = t.token and s.similarity >= 0.85 join names n on n.a = s.b
  where (t.repo_id, n.brand_id) not in (select (repo_id, brand_id) from sure)
  qualify row_number() over (partition by t.repo_id, n.brand_id order by t.rank, t.entry, t.line, t.k, n.k) = 1
), proofs as (select * from sure union all select *, 1 from fuzzy)""" + BEST)
def _(t):
    return best_brands(t, exact_only=False)


@query("keyword_matches", "O44 O58", BASE + f""", words(ord, k) as (values (0, 'login'), (2, 'verification'), (3, 'the'), (4, 'kit'), (5, 'zebra'), (6, 'otp')),
found as (select repo_id, ord, rank, line from units u join words on {WORD.format(u="u.text", k="k")}
  qualify row_number() over (partition by repo_id, ord order by rank, entry, line) = 1)
select repo_id, ord, cast(row_number() over (partition by repo_id
  order by ord) as int) as turn, rank, line as line_number from found qualify turn <= 5""")
def _(t):
    c = suspects.context(t)
    words = [(0, "login"), (1, "Login"), (2, "verification"), (3, "the"), (4, " kit "), (5, "zebra"), (6, "OTP")]
    found = B.keyword_matches(units.text_units(c), c, t.rows(words, "ord int, keyword string"))
    return found.select("repo_id", "ord", "turn", "rank", "line_number")


@query("shallow_brand", "O45", f"""
with recursive r as (
  select repo_id, lower(owner) as o, lower(full_name || ' ' || coalesce(description, '') || ' ' || case
    when repo_id % 4 = 0 then '' else 'automobil tool' end) as t from {{repositories}}
  union all select repo_id + 1000000000, 'nobody', lower(regexp_replace(full_name, '^.*/', '')) || '  '
    from {{repositories}}
), n as (select brand_id, unnest([lower(brand_name)] || string_split(aliases, ',')) as a,
  string_split(lower(trusted_owners), ',') as owners from {{brands}}),
pairs as (select distinct r.t as a, n.a as b from r, n where abs(length(r.t) - length(n.a)) <= 12),{JARO}
select r.repo_id, cast(arg_min(h.brand_id, h.late * 1000 + h.brand_id) as int) as brand_id from r left join (
  select repo_id, brand_id, case when list_contains(owners, o) then 0 else 1 end as late from r
    join n on list_contains(owners, o) or contains(t, a)
  union all select repo_id, brand_id, 1 from r join alike s on s.a = r.t and s.similarity >= 0.85
    join n on n.a = s.b) h on h.repo_id = r.repo_id
group by r.repo_id""")
def _(t):
    r = t("repositories").select("repo_id", "owner", "full_name", "description")
    r = r.withColumn("topics", F.expr("if(repo_id % 4 = 0, array(), array('automobil', 'tool'))").cast("array<string>"))
    bare = r.select(
        (F.col("repo_id") + 1_000_000_000).alias("repo_id"),
        F.lit("nobody").alias("owner"),
        F.regexp_replace("full_name", "^.*/", "").alias("full_name"),
        F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("topics"),
    )
    return B.shallow_brand(r.unionByName(bare), brands(t)).select(
        "repo_id", F.col("brand_id").cast("int").alias("brand_id")
    )


# --- texts ------------------------------------------------------------------------------------------------------

#: Characters that a snippet is trimmed of, in SQL.
BLANKS = " || ".join(
    f"chr({c})"
    for c in (*range(9, 14), 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279)
)


@query("snippets", "O46", f"""
select doc_id, case when i - 41 > 0 then '…' else '' end
  || trim(substr(text, cast(greatest(0, i - 41) + 1 as bigint), cast(least(length(text), i + 42) - greatest(0,
    i - 41) as bigint)), {BLANKS})
  || case when i + 42 < length(text) then '…' else '' end as shown
from (select doc_id, text, strpos(lower(text), 'the') as i from {{documents}}) x where i > 0""")
def _(t):
    rows = t("documents").withColumn("at", F.position(F.lit("the"), F.lower("text")) - 1).where("at >= 0")
    return rows.select("doc_id", T.snippet(F.col("text"), F.col("at"), F.lit(3)).alias("shown"))


QUOTED = r'''"(?:[^"\\]|\\.){3,300}"|''(?:[^''\\]|\\.){3,300}'''
STOPWORDS = ", ".join(f"'{w}'" for w in K.STOPWORDS)
BOILERPLATE = ", ".join(f"'{w}'" for w in K.BOILERPLATE)


@query("distinctive_phrases", "O78", """
with l as (select doc_id, line_number, case when len(q) > 0 then [x[2:-2] for x in q] else [line] end as parts
  from (select *, regexp_extract_all(line, 'QUOTED''') as q from (LINES) y) z),
s as (select doc_id, line_number * 100000 + unnest(range(len(parts))) as pos, trim(regexp_replace(unnest(parts), '\\s+',
  ' ', 'g')) as text from l),
c as (select *, len([w for w in regexp_extract_all(lower(text), '[a-z]{2,}') if length(w) >= 4
  and w not in (STOPWORDS)]) as n from s
  where length(text) between 12 and 200 and lower(text) not in (BOILERPLATE)),
d as (select * from c where n >= 3 qualify row_number() over (partition by doc_id, lower(text) order by pos) = 1)
select doc_id, text, cast(n as int) as significant_words, row_number() over (partition by doc_id
  order by n desc, pos) as turn from d"""
  .replace("STOPWORDS", STOPWORDS).replace("BOILERPLATE", BOILERPLATE).replace("QUOTED", QUOTED).replace("LINES", LINES))
def _(t):
    return extract.phrases(t("documents"), "doc_id", "text").withColumn("turn", F.col("turn").cast("long"))


@query("phrase_reuse", "O63", f"""
with l as ({LINES}),
p as (select item_id * 1000 + unnest(range(len(s))) as phrase_id, lower(unnest(s)) as low
  from (select item_id, string_split(text, chr(10)) as s from {{benchmark}}) x)
select doc_id as repo_id, phrase_id, min(line_number) as line_number from l join p on contains(lower(line), low)
  where low <> '' group by doc_id, phrase_id
qualify row_number() over (partition by doc_id order by phrase_id) <= 10""")
def _(t):
    lines = units.exploded_lines(documents(t))
    phrases = t("benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("k", "text")).where(
        "text <> ''"
    )
    phrases = phrases.select((F.col("item_id") * 1000 + F.col("k")).alias("phrase_id"), "text")
    found = rules.phrase_reuse(lines, phrases)
    return found.select("repo_id", "phrase_id", F.col("line_number").cast("long").alias("line_number"))


@query("contacts", "O67", """
with c(kind, pattern, part) as (values PATTERNS), d as (
  select doc_id,
    text || ' see t.me/User_' || doc_id % 7 || ' or https://wa.me/91987' || doc_id % 9 || '0 DISCORD.gg/inv-' || doc_id % 5
    || ' 0x' || sha1(cast(doc_id as varchar)) || ' mail you@example.com or A.' || doc_id % 3 || '@corp.test' as text
      from {documents})
select distinct doc_id, kind, case when kind = 'crypto_wallet' then v else lower(v) end as value
from (select doc_id, kind, unnest(regexp_extract_all(text, pattern, part)) as v from d, c) x
where not (kind = 'email' and (lower(v) in (NOBODY) or regexp_matches(lower(split_part(v, '@', 2)), 'DOMAIN')))"""
  .replace("PATTERNS", ", ".join(f"('{k}', '{p}', {g})".replace("{40}", "{40,40}") for k, p, g in K.CONTACTS)).replace("DOMAIN", K.PLACEHOLDER_DOMAIN)
  .replace("NOBODY", ", ".join(f"'{e}'" for e in K.PLACEHOLDER_EMAILS)))
def _(t):
    k = F.col("doc_id")
    more = F.concat(
        F.lit(" see t.me/User_"), k % 7, F.lit(" or https://wa.me/91987"), k % 9, F.lit("0 DISCORD.gg/inv-"), k % 5,
        F.lit(" 0x"), F.sha1(k.cast("string").cast("binary")), F.lit(" mail you@example.com or A."), k % 3, F.lit("@corp.test"),
    )
    return t("documents").select("doc_id", F.inline(extract.contacts(F.concat("text", more))))


@query("private_addresses", "O70", """
select p_partkey, ip, case when a > 255 or b > 255 then false else a in (127, 10, 0) or (a = 172 and b between 16
  and 31) or (a = 192 and b = 168) or (a = 169 and b = 254) end as private
from (select *, cast(a as string) || '.' || cast(b as string) || '.1.2' as ip from (
  select p_partkey, case p_partkey % 8 when 0 then 10 when 1 then 172 when 2 then 192 when 3 then 169 when 4 then 127
    else p_partkey % 300 end as a,
    case p_partkey % 3 when 0 then p_size when 1 then 168 else 254 end as b from {part}) x) y""")
def _(t):
    rows = t("part").selectExpr("p_partkey", "concat_ws('.', case p_partkey % 8 when 0 then 10 when 1 then 172 when 2 then 192 when 3 then 169 when 4 then 127 else p_partkey % 300 end, "
                                "case p_partkey % 3 when 0 then p_size when 1 then 168 else 254 end, '1.2') as ip")  # fmt: skip
    return rows.select("p_partkey", "ip", extract.is_private_ipv4(F.col("ip")).alias("private"))


@query("data_destinations", "O68", f"""
with f as (
  select repo_id, brand_name, 0 as ord, 'README.md' as path, readme_text as content from {{suspects}} left
    join {{brands}} using (brand_id)
  union all select repo_id, brand_name, 1, 'src/run.py', code from {{suspects}} left join {{brands}} using (brand_id)
    where code is not null
), h as (select repo_id, brand_name, ord, path, p, regexp_extract_all(content, pattern, 1) as hits from f,
  (values (0, '{K.DESTINATIONS[0].replace("'", "''")}'), (1, '{K.DESTINATIONS[1].replace("'", "''")}'), (2,
    '{K.DESTINATIONS[2].replace("'", "''")}')) pt(p, pattern)),
u as (select repo_id, brand_name, path, ord * 100000000 + p * 1000000 + unnest(range(len(hits))) as place,
  unnest(hits) as url from h),
w as (
  select repo_id, host, min(place) as place, arg_min(path, place) as source
  from (select *, lower(regexp_extract(url, '^(?i:https?)://([^/?#]+)', 1)) as host from u
    where regexp_matches(url, '(?i)^https?://')) v
  where host not in ({", ".join(f"'{x}'" for x in K.BENIGN_HOSTS)})
    and not list_contains([regexp_replace(x, '[^a-z0-9]', '', 'g') for x in string_split(host, '.')],
      regexp_replace(lower(coalesce(brand_name, '')), '[^a-z0-9]', '', 'g'))
  group by repo_id, host)
select repo_id, host as hostname, source, cast(row_number() over (partition by repo_id order by place) as int) as turn
  from w qualify turn <= 8""")
def _(t):
    rows = t("suspects").join(t("brands").select("brand_id", "brand_name"), "brand_id", "left")
    file = lambda k, path, text: F.struct(
        F.lit(k).alias("ord"), F.lit(path).alias("path"), F.col(text).alias("content")
    )
    both = F.array(file(0, "README.md", "readme_text"), file(1, "src/run.py", "code"))
    files = rows.select("repo_id", "brand_name", F.inline(both))
    found = extract.destinations(files, F.array(F.coalesce("brand_name", F.lit(""))))
    return found.select("repo_id", "hostname", "source", F.col("turn").cast("int").alias("turn"))


@query("synthetic_index", "O84", """
select p_partkey, 200000 + list_reduce([cast(0 as bigint)] || [cast(ascii(c) as bigint) for c in string_split(q, '')],
  lambda h, c: (h * 31 + c) % 4294967296) % 800000 as idx
from (select p_partkey, p_name || ' ' || p_partkey as q from {part}) x""")
def _(t):
    q = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", hashing.synthetic_index(200_000, q).alias("idx"))


@query("intent_answers", "O91", """
select answer_id, case when answer_id % 4 < 3 then case when p_size % 5 = 0 then 'malicious' when p_size % 5 = 1
  then 'suspicious' when p_size % 5 = 2 then 'benign' else 'inconclusive' end end as intent,
  case when answer_id % 4 < 3 then greatest(0, least(100, p_size * 5 - 30))::double end as risk_score,
  case when answer_id % 4 < 3 then case when p_size % 3 = 0 then greatest(0, least(1, p_size % 4 - 1))::double
    else (p_size % 10) / 10 end end as confidence,
  case when answer_id % 4 < 3 then case when p_size % 7 = 0 then 'No reasoning provided by model.'
    else p_name end end as reasoning from {answers}""")
def _(t):
    a = intent.parsed(F.col("text"))
    return t("answers").select(
        "answer_id", *(a[c].alias(c) for c in ("intent", "risk_score", "confidence", "reasoning"))
    )


@query("chunk_overlap", "O111", """
with texts as (select 0 as side, doc_id as id, text from {documents} union all select 1, item_id, text
  from {benchmark}),
w as (select side, id, regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]') as w from texts),
h as (select side, id, [substr(sha256(array_to_string(w[s : s + 24], chr(1))), 1, 16) for s in range(1, greatest(1,
  len(w) - 24) + 1)] as h from w where len(w) > 0),
f as (select side, id, list_distinct(case when len(h) <= 4 then h else [list_min(h[s : s + 3]) for s in range(1,
  greatest(1, len(h) - 3) + 1)] end) as f from h),
c as (select side, id, len(f) as n, unnest(f) as h from f)
select a.id as doc_id, b.id as item_id, count(*) as shared, round(count(*) / any_value(a.n), 6) as containment from c a
  join c b on a.h = b.h and a.side = 0 and b.side = 1 group by a.id, b.id""")
def _(t):
    found = rules.chunk_overlap(winnowed(t), winnowed(t, "benchmark", "item_id"), "doc_id", "item_id")
    return found.select("doc_id", "item_id", "shared", F.round("containment", 6).alias("containment"))


# --- paths ------------------------------------------------------------------------------------------------------

NAMED = "(select ord, path, lower(path) as p, lower(regexp_extract(path, '[^/]*$')) as name from {tree}) x"
TEXT = K.TEXT_FILE.replace("'", "''")


@query("path_priority", "O24", f"""
select ord, path, case when name = '.env' or starts_with(name, '.env.') then 100
  when name in ('credentials.json', 'secrets.json', 'serviceaccount.json', 'service-account.json') then 93
  when name in ('firebase.json', 'google-services.json', '.firebaserc') then 92
  when regexp_matches(p, '[.](pem|key|jks|p12|pfx)$') or contains(p, 'id_rsa') or contains(p, 'id_ed25519') then 95
  when contains(p, 'credential') or contains(p, 'secret') or contains(p, 'password') then 90
  when name in ('.npmrc', '.pypirc', 'netrc') then 88
  when regexp_matches(p, '{TEXT}') and contains(p, 'machinery') then 82
  when name in ('docker-compose.yml', 'docker-compose.yaml', 'package.json', 'package-lock.json', 'requirements.txt',
    'pom.xml', 'build.gradle', 'gradle.properties') then 85
  when suffix(name, '.tfvars') then 84 when name = 'dockerfile' or starts_with(name, 'dockerfile.') then 80
  when name in ('appsettings.json', 'config.json') then 78 when contains(p, '.github/workflows/') then 75
    when starts_with(name, 'readme') then 70
  when regexp_matches(p, '[.](properties|json|yml|yaml)$') then 60 when regexp_matches(p, '{TEXT}') then 40
    else 0 end as priority
from {NAMED}""")
def _(t):
    score = paths.priority(F.col("path"), F.array(F.lit("Machinery")))
    return t("tree").select("ord", "path", score.cast("int").alias("priority"))


@query("content_kind", "O26", f"""
select ord, case when name in ({", ".join(f"'{x}'" for x in K.BOILERPLATE_FILES)}) then ''
  when regexp_matches(p, '{K.LOCALE_PATH}') or regexp_matches(name, '{K.LOCALE_FILE}') then 'locale'
    when regexp_matches(p, '{K.TEMPLATE_PATH}') then 'template'
  when regexp_matches(name, '{K.LEGAL_FILE}') then 'legal' when regexp_matches(name, '{K.DOCS_FILE}')
    or regexp_matches(p, '{K.PROSE_PATH}') then 'docs' else '' end as kind
from {NAMED}""")
def _(t):
    return t("tree").select("ord", F.coalesce(paths.content_kind(F.col("path")), F.lit("")).alias("kind"))


@query("excluded_paths", "O6 O7", f"""
select ord, list_has_any(string_split(path, '/'), [{", ".join(f"'{x}'" for x in K.EXCLUDED_DIRS)}]) as excluded,
  name = 'readme' or regexp_matches(name, '^readme[.][a-z0-9]+$') as readme from {NAMED}""")
def _(t):
    return t("tree").select(
        "ord", paths.is_excluded(F.col("path")).alias("excluded"), paths.is_readme(F.col("path")).alias("readme")
    )


@query("patch_files", "O8", """
select l_orderkey as repo_id, 'history/' || substr(md5(cast(l_partkey as string)), 1,
  7) || '/f' || l_linenumber as path, 'new ' || l_partkey || chr(10) || 'x' as content from {lineitem}
qualify dense_rank() over (partition by l_orderkey
  order by l_linenumber) <= 15 and row_number() over (partition by l_orderkey order by l_linenumber) <= 30""")
def _(t):
    return source.history_files(patches(t("lineitem"))).select("repo_id", "path", "content")


# --- searches ---------------------------------------------------------------------------------------------------

LANGUAGES = "['JavaScript', 'TypeScript', 'Python', 'Java', 'Go', 'PHP', 'Ruby', 'Shell']"


@query("query_splits", "O142", f"""
with q as (select p_partkey, p_size, p_name from {{part}} where p_partkey % 2 = 0),
languages as (select p_name as query, g as part, p_name || case when g = 8
  then array_to_string([' -language:' || x for x in {LANGUAGES}], '')
  else ' language:' || {LANGUAGES}[g + 1] end as into, 1 as depth
  from q, range(9) r(g) where p_size % 3 = 0),
sizes as (select query, part, case part when 0 then 'w size:' || low || '..' || middle
  else 'w size:' || (middle + 1) || '..' || high end as into, depth from (
  select *, low + (high - low) // 2 as middle
    from (select p_partkey as low, p_partkey + p_size * 1000 as high,
    'w size:' || p_partkey || '..' || (p_partkey + p_size * 1000) as query, p_size % 9 + 1 as depth, p_size from q) x
  where p_size % 9 < 7) y, range(2) r(part)),
days as (select query, part, case part when 0 then 'created:' || low || '..' || strftime(middle - interval '1' second,
  '%Y-%m-%dT%H:%M:%SZ') else 'created:' || strftime(middle, '%Y-%m-%dT%H:%M:%SZ') || '..' || high end as into, depth
  from (
  select *, timestamp '2020-01-01' + to_milliseconds((cast(p_size as bigint) * 86400000 + 86399999) // 2) as middle
    from (
    select '2020-01-01' as low, strftime(date '2020-01-01' + cast(p_size as int), '%Y-%m-%d') as high,
      'created:2020-01-01..' || strftime(date '2020-01-01' + cast(p_size as int), '%Y-%m-%d') as query,
      p_size % 12 + 1 as depth, p_size from q) x
  where p_size % 12 < 10) y, range(2) r(part))
select 'language' as by, * from languages union all select 'size', * from sizes union all select 'created', *
  from days""")
def _(t):
    rows = t("part").selectExpr("*", "if(p_partkey % 2 = 0, 950, 949) as total", "1 as page")
    until = "date_format(date_add(date '2020-01-01', cast(p_size as int)), 'yyyy-MM-dd')"
    asked = {
        "language": ("p_name", "p_size % 3"),
        "size": ("concat('w size:', p_partkey, '..', p_partkey + p_size * 1000)", "p_size % 9"),
        "created": (f"concat('created:2020-01-01..', {until})", "p_size % 12"),
    }
    out = None
    for by, (text, depth) in asked.items():
        deepest = 10 if by == "created" else 7
        found = discovery.splits(rows.selectExpr(f"{text} as query", "total", "page", f"{depth} as depth"), by, deepest)
        found = found.select(
            F.lit(by).alias("by"),
            "query",
            F.col("part").cast("long").alias("part"),
            "into",
            F.col("depth").cast("long").alias("depth"),
        )
        out = found if out is None else out.unionByName(found)
    return out


@query("halved_ranges", "O88 O142", """
select p_partkey, part, case when part = 0 then 'size:' || low || '..' || middle
  else 'size:' || (middle + 1) || '..' || high end as half
from (select *, low + (high - low) // 2 as middle from (select p_partkey, p_partkey as low, p_partkey + p_size as high
  from {part}) x where high - low >= 16) y, range(2) r(part)""")
def _(t):
    q = F.concat(F.lit("size:"), F.col("p_partkey"), F.lit(".."), F.col("p_partkey") + F.col("p_size"))
    return t("part").select("p_partkey", F.posexplode(dates.halved_size(q)).alias("part", "half")).withColumn(
        "part", F.col("part").cast("long")
    )


#: Look-alike names of a term `b` in SQL, in order.
VARIANTS = """list_filter(list_distinct_in_order, lambda v: length(v) >= 4 and v <> b)""".replace(
    "list_distinct_in_order", "[x for x, k in every if list_position(every, x) = k]"
)
EVERY = f"""[b || x for x in [{", ".join(f"'-{s}', '{s}'" for s in K.LURE_SUFFIXES)}]] || [translate(b, 'oea', '034'), b || 'e']
  || case when length(b) > 4 then [substr(b, 1, h) || substr(b, h + 2), substr(b, 1, h) || substr(b, h + 2,
    1) || substr(b, h + 1, 1) || substr(b, h + 3)] else [] end"""


@query("typo_variants_all", "O79", f"""
select p_partkey, unnest({VARIANTS}) as variant from (select *, {EVERY} as every from (
  select p_partkey, b, length(b) // 2 as h
    from (select p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as b from {{part}}) x
    where length(b) >= 3) y) z""")
def _(t):
    return t("part").select("p_partkey", F.explode(discovery.variants(F.col("p_name"), 100)).alias("variant"))


#: Families of queries of all brands in SQL: `specs`, a row of each before dates, repeats and the cap.
FAMILIES = f"""
with best as (select category, list(keyword order by turn) as words from (
  select *, row_number() over (partition by category order by priority desc, lower(keyword), keyword) as turn
    from {{keywords}} where enabled) x where turn <= 6 group by category),
chosen as (select
  coalesce((select words from best
    where category = 'phishing'), ['phishing', 'login'])[1:4] as phishing, coalesce((select words from best
    where category = 'malware'), ['apk', 'stealer'])[1:4] as malware,
  coalesce((select words from best where category = 'secret'), ['AKIA', 'ghp_']) as secret, coalesce((select words
    from best where category = 'brand'), [])[1:5] as named),
terms as (select brand_id as brand, term, case when contains(term, ' ') then '"' || term || '"' else term end as p,
  regexp_replace(lower(term), '[^a-z0-9]', '', 'g') as b,
    [k for k, i in clean if k <> '' and lower(k) <> lower(term) and list_position([lower(x) for x in clean],
      lower(k)) = i] as own,
    [x for x in string_split(trusted_owners, ',') if x <> ''] as owners
  from (select *, substr(replace(trim(coalesce(nullif(string_split(keywords, ',')[1], ''), brand_name)),
    '"', ''), 1, 40) as term,
    [substr(trim(replace(k,
      '"', '')), 1, 100) for k in string_split(keywords, ',') if k <> ''] as clean from {{brands}}) x),
names as (select brand, term, p, {VARIANTS} as v from (select *, {EVERY} as every from (select *, length(b) // 2 as h
  from terms) x) y),
said as (select item_id % 4 as brand, item_id // 4 as part, trim(replace(substr(text, 1, 60),
  '"', '')) as v from {{benchmark}} where item_id // 4 < 5),
specs(brand, grp, part, family, kind, query) as (
  select brand, 0, 0, 'phishing', 'repositories', p || ' (' || array_to_string(phishing,
    ' OR ') || ') in:name,description' from terms, chosen
  union all select brand, 1, 0, 'apk', 'repositories', p || ' (' || array_to_string(malware,
    ' OR ') || ') in:name,description' from terms, chosen
  union all select brand, 2, 0, 'impersonation', 'repositories',
    p || ' (clone OR spoof OR fake OR unofficial) in:name,description' from terms
  union all select brand, 3, unnest(range(len(v[1:3]))), 'typo-squat', 'repositories', unnest(v[1:3]) || ' in:name'
    from names
  union all select brand, 4, unnest(range(len(own))), 'brand-keyword-custom', 'repositories',
    unnest([p || ' "' || k || '"' || case when contains(k, '/') then ' in:description'
    else ' in:name,description' end for k in own]) from terms
  union all select brand, 5, 0, 'brand-secret', 'code', '"' || term || '" (' || array_to_string(secret[1:4],
    ' OR ') || ')' from terms, chosen
  union all select brand, 6, unnest(range(len(own))), 'brand-keyword-custom-code', 'code',
    unnest(['"' || term || '" "' || k || '"' for k in own]) from terms
  union all select brand, 7, part, 'distinctive-content', 'code', '"' || v || '"' from said where v <> ''
  union all select brand, 8, unnest(range(2 * len(owners))), 'trusted-account', 'repositories',
    unnest(flatten([['org:' || o, 'user:' || o] for o in owners])) from terms
  union all select 1000000, 0, unnest(range(len(named))), 'brand-keyword', 'repositories',
    unnest([k || ' (login OR apk OR phishing) in:name,description' for k in named]) from chosen
  union all select 1000000, 1, unnest(range(len(q))), 'secret-filename', 'code', unnest(q)
    from (select [{", ".join(f"'{q}'" for q in K.SECRET_FILE_QUERIES)}] || ['filename:.env ' || k for k in secret[1:6]] as q from chosen) x
), dated as (
  select *, query || suffix as q from (select * from specs
    where kind = 'code') a, (select 0 as k, ' fork:true' as suffix) c
  union all select *, query || suffix from (select * from specs
    where kind <> 'code') a, (values (0, ' created:>=2024-01-01'), (1, ' pushed:>=2024-01-01')) c(k, suffix)
), once as (select * from dated where length(q) <= 250 qualify row_number() over (partition by kind, q
  order by brand, grp, part, k, family) = 1)
"""


@query("query_families", "O140", FAMILIES + """
select cast(row_number() over (order by brand, grp, part, k, family) - 1 as int) as ord, family, kind, q as query
  from once qualify ord < 60""")
def _(t):
    phrases = t("benchmark").selectExpr(
        "item_id % 4 as brand_id", "substring(text, 1, 60) as text", "cast(item_id div 4 as int) + 1 as turn"
    )
    dated = (" created:>=2024-01-01", " pushed:>=2024-01-01")
    out = discovery.query_families(brands(t), t("keywords"), phrases, most=60, date_suffixes=dated)
    return out.select(F.col("ord").cast("int").alias("ord"), "family", "kind", "query")


#: The queries of one keyword in SQL: with a brand's own term, that; else the keyword, once.
SCOPED = """
with t as (select brand_id, substr(replace(trim(coalesce(nullif(string_split(keywords, ',')[1], ''), brand_name)),
  '"', ''), 1, 40) as term from {brands}),
s as (select w.word, brand_id, case when lower(term) = lower(word) then term else word end as k,
  lower(term) = lower(word) as same from t, (values ('wallet'), ('Machinery'), ('two words')) w(word)),
q as (
  select word, 0 as grp, brand_id, 'brand-keyword-custom' as family, 'repositories' as kind, case when contains(k, ' ')
    then '"' || k || '"' else k end as query from s
  union all select word, 1, brand_id, 'brand-keyword-custom-code', 'code', '"' || k || '" fork:true' from s
), once as (select * from q qualify row_number() over (partition by word, kind, query order by brand_id, grp) = 1)
"""


def scoped(t, word: str):
    return discovery.query_families(brands(t), t("keywords"), only_keyword=word, secret_files=False)


@query(
    "keyword_scope",
    "O141",
    SCOPED + "select word, cast(row_number() over (partition by word order by brand_id, grp) - 1 as int) as ord, family, query from once",
)
def _(t):
    one = lambda w: scoped(t, w).select(
        F.lit(w).alias("word"), F.col("ord").cast("int").alias("ord"), "family", "query"
    )
    return one("wallet").union(one("Machinery")).union(one("two words"))


@query("query_preview", "O169", SCOPED + """
select word, arg_min(query, brand_id) filter (where kind = 'repositories') as repo_query, arg_min(query,
  brand_id) filter (where kind = 'code') as code_query from once group by word""")
def _(t):
    one = lambda w: discovery.preview(scoped(t, w)).select(
        F.lit(w).alias("word"), "repo_query", "code_query"
    )
    return one("wallet").union(one("Machinery")).union(one("two words"))


@query("seeded_keywords", "O14", f"""
select keyword, category, cast(priority as int) as priority, (select count(*) from {{documents}}
  where contains(lower(text), keyword)) as documents
from (values {", ".join(f"('{k}', '{c}', {p})" for k, c, p in K.SEEDED_KEYWORDS)}) t(keyword, category, priority)""")
def _(t):
    seeds = t.rows(list(K.SEEDED_KEYWORDS), "keyword string, category string, priority int")
    found = t("documents").select(
        F.explode(T.terms_in(F.lower("text"), tuple(k for k, _, _ in K.SEEDED_KEYWORDS))).alias("keyword")
    )
    counts = found.groupBy("keyword").agg(F.count("*").alias("documents"))
    return seeds.join(counts, "keyword", "left").fillna({"documents": 0})


@query("seeded_brands", "O14", f"""
select brand, alias, (select count(*) from {{repositories}}
  where contains(lower(owner || coalesce(description, '') || ' kite ' || (repo_id % 3)), alias)) as repositories
from (values {", ".join(f"('{b}', '{a}')" for b, names, _ in K.SEEDED_BRANDS for a in names)}) t(brand, alias)""")
def _(t):
    seeds = t.rows([(b, list(names)) for b, names, _ in K.SEEDED_BRANDS], "brand string, aliases array<string>")
    text = F.lower(F.concat("owner", F.coalesce("description", F.lit("")), F.lit(" kite "), F.col("repo_id") % 3))
    found = t("repositories").select(
        F.explode(T.terms_in(text, tuple(a for _, names, _ in K.SEEDED_BRANDS for a in names))).alias("alias")
    )
    counts = found.groupBy("alias").agg(F.count("*").alias("repositories"))
    return seeds.select("brand", F.explode("aliases").alias("alias")).join(counts, "alias", "left").fillna(
        {"repositories": 0}
    )


# --- findings ---------------------------------------------------------------------------------------------------

@query("branch_never_resolves", "O144 O168", """
with f as (select finding_id, coalesce(status, 'open') as status, finding_id % 3 > 0 as seen from {findings})
select b.branch, change, count(*) as n from (values (true), (false)) b(branch), lateral (
  select case when not seen and status in ('open', 'acknowledged') and not branch then 'resolved'
    when not seen then 'before' when status = 'resolved' then 'reopened' else 'unchanged' end as change from f) x
group by b.branch, change""")
def _(t):
    f = t("findings").selectExpr(
        "finding_id as key",
        "coalesce(status, 'open') as status",
        "severity",
        "risk_score as score",
        "'before' as last_change_type",
    )
    seen, at = f.where("key % 3 > 0").select("key", "severity", "score"), F.lit("2024-01-10").cast("timestamp")
    both = [lifecycle.merged_findings(f, seen, at, resolve=not b).withColumn("branch", F.lit(b)) for b in (True, False)]
    return both[0].unionByName(both[1]).groupBy("branch", F.col("last_change_type").alias("change")).agg(
        F.count("*").alias("n")
    )


@query("category_outside_class", "O16", """
select finding_id from {findings}
  where list_contains(string_split(categories, ','), 'phishing') and list_has_any(string_split(categories, ','),
  ['exposed_secret', 'credential_reuse'])
  and 'phishing' in ('exposed_secret', 'credential_reuse')
union all select -finding_id from {findings} where list_contains(string_split(categories, ','), 'exposed_secret')""")
def _(t):
    f = t("findings").withColumn("categories", F.split("categories", ","))
    outside = views.findings_filter(f, category="phishing", threat_class="credential_exposure").select("finding_id")
    inside = views.findings_filter(f, category="exposed_secret", threat_class="credential_exposure")
    return outside.union(inside.select(-F.col("finding_id")))


@query("anti_unseen", "O102 O139", """
with seen as (select repo_id from {findings} where risk_score > 95)
select r.repo_id, (select count(distinct repo_id) from seen) as hidden from {repositories} r
  where r.repo_id not in (select repo_id from seen)""")
def _(t):
    r, seen = t("repositories").select("repo_id"), t("findings").where("risk_score > 95")
    hidden = r.join(seen.select("repo_id").distinct(), "repo_id", "left_semi").agg(F.count("*").alias("hidden"))
    return views.unseen(r, seen).join(hidden, F.lit(True))


@query("ad_hoc_search", "O164", """
select repo_id from {repositories} where contains(full_name, 'login') and repo_id not in (select repo_id from {findings}
  where risk_score > 95) order by repo_id limit 10 offset 10""")
def _(t):
    hits = t("repositories").where(F.contains("full_name", F.lit("login"))).select("repo_id")
    return views.page(views.unseen(hits, t("findings").where("risk_score > 95")).orderBy("repo_id"), 2, 10)


@query("finding_detail", "O171", """
select f.finding_id, r.full_name, d.rules from {findings} f left join {repositories} r on r.repo_id = f.repo_id
left join (select finding_id, string_agg(rule_id, ',' order by ord, rule_id) as rules from {detections}
  group by finding_id) d on d.finding_id = f.finding_id""")
def _(t):
    rows = views.finding_detail(t("findings"), t("repositories"), t("detections"))
    return rows.select(
        "finding_id", "full_name", F.array_join(F.transform("detections", lambda d: d["rule_id"]), ",").alias("rules")
    )


@query("score_breakdown", "O125", f"""
with p as (select *, floor(risk_contribution * (0.5 + confidence * 0.5) * pow(0.6,
  row_number() over (partition by finding_id, rule_id
  order by risk_contribution * (0.5 + confidence * 0.5) desc, ord) - 1) + 0.5) as points
  from {{detections}}),
g as (select finding_id, list(distinct category) as c, sum(points) as base from p group by finding_id),
r as (select g.*, r.stars, r.forks, len(c) as n, g.finding_id % 3 as brands, g.finding_id % 4 as owners,
    list_has_any(c, [{", ".join(f"'{c}'" for c in K.INTENT_CATEGORIES)}]) as intent,
      epoch(timestamp '2024-01-10' - r.created_at) / 86400 as age
  from g left join {{findings}} f on f.finding_id = g.finding_id left join {{repositories}} r on r.repo_id = f.repo_id),
a as (
  select finding_id, 'Multiple threat categories' as factor, case when n >= 3 then 10 else 5 end as points from r
    where n >= 2
  union all select finding_id, 'High repository reputation', -12 from r
    where intent and stars >= 1000 and forks / stars >= 0.02
  union all select finding_id, 'Possibly inflated stars', 6 from r
    where intent and stars >= 1000 and forks / stars < 0.02
  union all select finding_id, 'Very low popularity', 6 from r where intent and coalesce(stars, 0) <= 1
  union all select finding_id, 'Very new repository', 8 from r where intent and age <= 14
  union all select finding_id, 'Repeat operator pattern', least(20, 8 + brands * 6) from r where brands > 0
  union all select finding_id, 'Linked to other identities', least(30, 15 + owners * 8) from r where owners > 0
  union all select finding_id, rule_name, points from p)
select finding_id, cast(greatest(0, least(100, sum(points) over (partition by finding_id))) as bigint) as score, factor,
  cast(points as bigint) as points from a""")
def _(t):
    repos = t("findings").select("finding_id", "repo_id").join(t("repositories"), "repo_id").select(
        "finding_id", "stars", "forks", "created_at"
    )
    operators = t("findings").selectExpr(
        "finding_id", "finding_id % 3 as other_brands", "finding_id % 4 as linked_owners"
    )
    out = scoring.scores(t("detections"), repos, "finding_id", F.lit("2024-01-10").cast("timestamp"), operators)
    return out.select("finding_id", "score", F.explode("breakdown").alias("b")).select(
        "finding_id", "score", "b.factor", "b.points"
    )


# --- streams and state ------------------------------------------------------------------------------------------

@query("search_cache", "O160", """
with recursive e as (select event_type, user_id % 20 as u, epoch_us(ts) // 1000 as ms from {events}),
miss(event_type, u, ms) as (
  select event_type, u, min(ms) from e group by event_type, u
  union all select e.event_type, e.u, min(e.ms) from miss m
    join e on e.event_type = m.event_type and e.u = m.u and e.ms >= m.ms + 43200000 group by e.event_type, e.u
), n as (select event_type, u, count(*) as misses from miss
  group by event_type, u), c as (select event_type, u, count(*) as total from e group by event_type, u)
select event_type, u, hit, case when hit then total - misses else misses end as n from n
  join c using (event_type, u), (values (true), (false)) h(hit) where not hit or total > misses""")
def _(t):
    keys = ["event_type", "u"]
    e = t("events").withColumn("u", F.col("user_id") % 20)
    found = progress.deduplicated(e, keys, within_ms=43_200_000).join(e.select("event_id", *keys), "event_id")
    return found.groupBy(*keys, "hit").agg(F.count("*").alias("n"))


@query("gated_pacing", "O153", """
with recursive e as (select event_type as scope, event_id, epoch_us(ts) // 1000 as ms,
  row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) as n from {events}),
w(scope, n, event_id, last, wait) as (
  select scope, 0, cast(null as bigint), cast(0 as bigint), cast(0 as bigint) from (select distinct scope from e) x
  union all select scope, n, event_id, case when slot - ms <= 1200000 then slot else last end, slot - ms from (
    select e.scope, e.n, e.event_id, e.ms, w.last, greatest(w.last + 1000000, e.ms) as slot from w
      join e on e.scope = w.scope and e.n = w.n + 1) y
) select event_id, wait from w where n > 0""")
def _(t):
    return progress.gated(requests(t), 1_000_000, 1_200_000)


def rotations(t, replay):
    """replay(slots), a generator of rows, of each workspace's slots: a workspace is a record, many of them a table."""

    def rows(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        slots = tuple(
            rotation.Slot(0, k, int(p) * 1000) for k, p in zip(frame["keyword"], frame["priority"], strict=True)
        )
        out = pd.DataFrame(list(replay(slots)), columns=["step", "current", "ends_at", "cycles", "enabled"])
        out["ends_at"] = out["ends_at"].astype("Int64")
        return out.assign(ws=frame["ws"].iloc[0])

    slots = t("keywords").selectExpr("ord % 2 as ws", "ord", "keyword", "priority")
    return slots.groupBy("ws").applyInPandas(
        rows, "step int, current string, ends_at long, cycles int, enabled boolean, ws int"
    )


SLOTS = """slots as (select ws, keyword, priority * 1000 as ms, row_number() over (partition by ws order by ord) - 1 as i, count(*) over (partition by ws) as n
  from (select ord % 2 as ws, * from {keywords} qualify row_number() over (partition by ord % 2, lower(keyword)
    order by ord) = 1) x)"""


@query("rotation_replay", "O152 O167", f"""
with {SLOTS}, steps as (select k, k - (k + 1) // 3 as moves, (k + 1) // 3 as waits from range(20) r(k))
select cast(k as int) as step, s.keyword as current, case when moves < s.n then (select sum(ms) from slots o
  where o.ws = s.ws and o.i <= moves) + 31000 * waits end as ends_at,
  case when moves < s.n then 0 else 1 end as cycles, moves < s.n as enabled, s.ws from steps
    join slots s on s.i = least(moves, s.n - 1)""")
def _(t):
    def replay(slots):
        state = rotation.Rotation().added(slots).started(0, 0)
        for k in range(20):
            yield k, state.slots[state.current].keyword, state.ends_at, state.cycles, state.enabled
            state = state.advanced(state.ends_at or 0, paused_until=(state.ends_at or 0) + 1000 if k % 3 == 1 else None)

    return rotations(t, replay).withColumn("ends_at", F.col("ends_at").cast("long"))


@query("rotation_edits", "O167", f"""
with {SLOTS}, e(step, i, t0) as (values (0, 0, 0), (1, 1, 10), (2, 2, 20), (3, 2, 20), (4, 2, 20), (5, 4, 50), (6, 4,
  50), (7, 4, 50))
select cast(e.step as int) as step, s.keyword as current, e.t0 + s.ms as ends_at, case when e.step >= 7 then s.n - 1
  when e.step >= 3 then s.n - 2 when e.step >= 1 then s.n - 1 else s.n end as cycles, true as enabled, s.ws
from e join slots s on s.i = e.i""")
def _(t):
    def replay(slots):
        steps = (
            lambda s: s.removed(0, 10),  # the running one goes, the next one runs
            lambda s: s.paused(0, 20),  # so too if it's paused
            lambda s: s.removed(0, 30),  # one before it goes: it runs on, a place further up
            lambda s: s.paused(1, 40),  # another is paused: nothing else changes
            lambda s: s.advanced(50),  # the paused one is passed over
            lambda s: s.resumed(1, 60),
            lambda s: s.added((rotation.Slot(0, slots[-1].keyword.upper(), 1), rotation.Slot(0, "fresh", 1))),
        )
        state = rotation.Rotation().added(slots).started(0, 0)
        for k, step in enumerate((lambda s: s, *steps)):
            state = step(state)
            yield k, state.slots[state.current].keyword, state.ends_at, len(state.slots), state.enabled

    return rotations(t, replay)
