"""The rule engine: each rule makes an array of detections from a row of the context table.

The context has repo_id, full_name, owner, name, description, topics, stars, forks, is_fork,
created_at, owner_created_at, followers, public_repos, file_paths, readme_text, readme_path,
files (path, content) and brand (name, aliases, keywords, trusted_owners; null if none). All
rules are columns of one projection, so a repository's text is read once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import constants as K
from siltworks.functions import extract, secrets
from siltworks.functions import hashing as H
from siltworks.functions import text as T
from siltworks.operators import units

VERSION = "1"
DETECTION = (
    "struct<rule_id:string,rule_name:string,category:string,severity:string,confidence:double,risk_contribution:double,evidence:string,"
    "file:string,line_number:int,matched_text:string>"
)


@dataclass(frozen=True)
class Rule:
    """A rule: `found(as_of)` gives an array column of DETECTION structs, null or empty where it doesn't fire."""

    id: str
    name: str
    found: Callable[[Column], Column]


RULES: dict[str, Rule] = {}


def rule(identity: str, name: str):
    """Register a function of as_of as a rule."""

    def add(f):
        RULES[identity] = Rule(identity, name, f)
        return f

    return add


def detection(
    identity: str,
    category: str,
    severity,
    confidence,
    points,
    evidence: Column,
    file=None,
    line=None,
    matched=None,
) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(identity).alias("rule_id"), F.lit(RULES[identity].name if identity in RULES else identity).alias("rule_name"), F.lit(category).alias("category"),
        lit(severity).alias("severity"), lit(confidence).cast("double").alias("confidence"), lit(points).cast("double").alias("risk_contribution"),
        evidence.alias("evidence"), lit(file).cast("string").alias("file"), lit(line).cast("int").alias("line_number"), lit(matched).cast("string").alias("matched_text"),
    )


def one(condition: Column, found: Column) -> Column:
    return F.when(condition, F.array(found))


def whole_text() -> Column:
    contents = F.transform("files", lambda f: f["content"])
    return T.blob(
        F.col("full_name"), F.col("description"), F.col("topics"), F.col("readme_text"), F.col("file_paths"), contents
    )


def brand_named() -> Column:
    """Whether the brand's name or an alias is anywhere in the text."""
    names = F.concat(F.array("brand.name"), F.coalesce("brand.aliases", F.array().cast("array<string>")))
    return F.coalesce(F.exists(names, lambda a: F.contains(F.col("_text"), F.lower(a))), F.lit(False))


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000


def has_apk_file() -> Column:
    return F.exists("file_paths", lambda p: F.lower(p).endswith(".apk"))


def named_lures() -> Column:
    """Of the units that name the brand as a word and have suspicious terms as words: number, place, terms and path."""
    every = F.concat(F.array("brand.name"), F.coalesce("brand.aliases", F.array().cast("array<string>")))
    names = F.transform(every, lambda a: F.lower(a))

    def terms_of(u: Column) -> Column:
        return F.struct(u.alias("u"), T.whole_terms_in(F.lower(u["text"]), K.SUSPICIOUS_KEYWORDS).alias("terms"))

    def placed(h: Column) -> Column:
        u = h["u"]
        return F.struct(
            F.size(h["terms"]).alias("n"),
            (-u["rank"]).alias("r"),
            (-u["entry"]).alias("e"),
            (-u["line_number"]).alias("l"),
            h["terms"].alias("terms"),
            u["path"].alias("path"),
        )

    naming = F.filter("_units", lambda u: F.exists(names, lambda a: T.has_term(F.lower(u["text"]), a)))
    found = F.filter(F.transform(naming, terms_of), lambda h: F.size(h["terms"]) > 0)
    return F.transform(found, placed)


@rule("brand-impersonation", "Brand Impersonation")
def _impersonation(as_of: Column) -> Column:
    best, terms = F.array_max("_lures"), F.col("_lure_terms")
    n = F.size(terms)
    weak = F.forall(terms, lambda t: t.isin(*K.WEAK_SUSPICIOUS_KEYWORDS))
    official = (F.lower("owner") == F.regexp_replace(F.lower("brand.name"), r"\s+", "")) | (F.col("stars") >= 500)
    fires = F.col("brand.name").isNotNull() & (n > 0) & ~((weak | official) & (n < 2))
    made = detection(
        "brand-impersonation",
        "brand_impersonation",
        F.when(n >= 3, "high").otherwise("medium"),
        F.least(F.lit(0.9), 0.55 + n * 0.1),
        20 + F.least(F.lit(15), n * 4),
        F.concat(F.col("brand.name"), F.lit(": "), F.array_join(F.slice(terms, 1, 5), ", ")),
        best["path"],
        F.when(best["l"] < 0, -best["l"]),
    )
    return one(fires, made)


@rule("phishing-kit", "Phishing Indicators")
def _phishing(as_of: Column) -> Column:
    hits = T.terms_in(F.col("_text"), K.PHISHING_TERMS)
    n = F.size(hits)
    weak = F.forall(hits, lambda t: t.isin(*K.WEAK_PHISHING_TERMS))
    strength = n + F.col("_branded").cast("int")
    made = detection("phishing-kit", "phishing", F.when(strength >= 2, "critical").otherwise("high"), F.least(F.lit(0.92), 0.6 + strength * 0.1),
                     25 + F.least(F.lit(20), strength * 6), F.array_join(hits, ", "))
    return one((n > 0) & ~(weak & ~F.col("_branded") & (n < 2)), made)


@rule("fake-apk", "Fake Android / APK")
def _apk(as_of: Column) -> Column:
    hits, file = T.terms_in(F.col("_text"), K.APK_HINTS), has_apk_file()
    made = detection(
        "fake-apk",
        "fake_apk",
        F.when(file, "critical").otherwise("high"),
        F.when(file, 0.9).otherwise(0.75),
        F.when(file, 32).otherwise(24),
        F.array_join(hits, ", "),
    )
    return one(F.col("_branded") & ((F.size(hits) > 0) | file), made)


@rule("malware-indicators", "Malware Indicators")
def _malware(as_of: Column) -> Column:
    hits, weak = T.terms_in(F.col("_text"), K.MALWARE_TERMS), T.terms_in(F.col("_text"), K.WEAK_MALWARE_TERMS)
    scripted = F.exists("file_paths", lambda p: p.rlike(K.SCRIPT_FILE)) & (
        F.size(T.terms_in(F.col("_text"), ("crack", "bypass", "payload"))) > 0
    )
    n = F.size(hits) + F.size(weak)
    made = detection(
        "malware-indicators",
        "malware",
        F.when((n >= 2) | scripted, "critical").otherwise("high"),
        0.7,
        28 + F.least(F.lit(12), n * 4),
        F.array_join(F.concat(hits, weak), ", "),
    )
    return one((F.size(hits) > 0) | scripted, made)


@rule("low-reputation-new-repo", "Low Reputation / Newly Created")
def _reputation(as_of: Column) -> Column:
    new, few = F.coalesce(age_days(F.col("created_at"), as_of), F.lit(999.0)) <= 30, F.col("stars") <= 2
    made = detection(
        "low-reputation-new-repo",
        "suspicious_repo",
        "low",
        0.55,
        F.when(new & few, 12).otherwise(8),
        F.concat(F.lit("stars "), F.col("stars").cast("string")),
    )
    return one(F.col("_branded") & (new | few), made)


@rule("suspicious-owner-account", "Newly Created / Low-Reputation Account")
def _account(as_of: Column) -> Column:
    known = F.coalesce(
        F.col("owner_created_at").cast("string"),
        F.col("followers").cast("string"),
        F.col("public_repos").cast("string"),
    ).isNotNull()
    new = F.coalesce(age_days(F.col("owner_created_at"), as_of) <= 30, F.lit(False))
    empty = F.coalesce((F.col("followers") <= 0) & (F.col("public_repos") <= 1), F.lit(False))
    both = new & empty
    made = detection(
        "suspicious-owner-account",
        "suspicious_repo",
        F.when(both, "medium").otherwise("low"),
        F.when(both, 0.7).otherwise(0.5),
        F.when(both, 14).otherwise(8),
        F.col("owner"),
    )
    return one(F.col("_branded") & known & (new | empty), made)


@rule("disposable-phishing-repo", "Disposable Phishing Repo Pattern")
def _disposable(as_of: Column) -> Column:
    unused = (F.col("stars") == 0) & (F.col("forks") == 0) & ~F.coalesce(F.col("is_fork"), F.lit(False))
    new = F.coalesce(age_days(F.col("created_at"), as_of), F.lit(999.0)) <= 14
    some = [
        F.size(T.terms_in(F.col("_text"), K.PHISHING_TERMS)) > 0,
        (F.size(T.terms_in(F.col("_text"), K.APK_HINTS)) > 0) | has_apk_file(),
        F.size(T.terms_in(F.col("_text"), K.SUSPICIOUS_KEYWORDS)) > 0,
    ]
    k = some[0].cast("int") + some[1].cast("int") + some[2].cast("int")
    made = detection(
        "disposable-phishing-repo",
        "phishing",
        "high",
        F.least(F.lit(0.95), 0.75 + k * 0.07),
        15,
        F.concat(k.cast("string"), F.lit(" intent signals")),
    )
    return one(F.col("_branded") & unused & new & (k > 0), made)


@rule("obfuscated-commands", "Obfuscated / Encoded Commands")
def _obfuscated(as_of: Column) -> Column:
    hit = lambda t: t.rlike("|".join(K.OBFUSCATED_COMMANDS))
    content = F.lit(units.LOCATIONS.index("file_content"))
    found = F.filter("_units", lambda u: (u["line_number"] > 0) & hit(u["text"]))
    place = lambda u: F.struct(
        (u["rank"] != content).alias("late"),
        u["entry"],
        u["line_number"].alias("line"),
        F.when(u["rank"] == content, u["path"]).otherwise("README.md").alias("path"),
    )
    first = F.array_min(F.transform(found, place))
    made = detection(
        "obfuscated-commands",
        "malware",
        "high",
        0.8,
        22,
        F.concat(first["path"], F.lit(":"), first["line"].cast("string")),
        first["path"],
        first["line"],
        "Encoded/obfuscated command pattern",
    )
    return one(F.size(found) > 0, made)


@rule("custom-keyword-match", "Custom Keyword Match")
def _keywords(as_of: Column) -> Column:
    own = F.transform(
        F.concat(F.array("brand.name"), F.coalesce("brand.aliases", F.array().cast("array<string>"))),
        lambda a: F.lower(a),
    )
    asked = F.filter(
        F.transform(F.coalesce("brand.keywords", F.array().cast("array<string>")), lambda k: F.trim(k)),
        lambda k: (F.length(k) > 0) & ~F.array_contains(own, F.lower(k)),
    )
    low = F.transform(asked, lambda k: F.lower(k))
    asked = F.filter(asked, lambda k, i: F.array_position(low, F.lower(k)) == i + 1)

    def place(k: Column) -> Column:
        hit = F.filter("_units", lambda u: T.word_index(u["text"], F.lower(k)) >= 0)
        return F.struct(
            k.alias("keyword"),
            F.array_min(
                F.transform(hit, lambda u: F.struct(u["rank"], u["entry"], u["line_number"], u["text"], u["path"]))
            ).alias("u"),
        )

    def made(h: Column) -> Column:
        strong, u = h["u"]["rank"] <= units.LOCATIONS.index("file_path"), h["u"]
        shown = T.snippet(u["text"], T.word_index(u["text"], F.lower(h["keyword"])), F.length(h["keyword"]))
        return detection("custom-keyword-match", "custom_keyword_match", F.when(strong, "medium").otherwise("low"), F.when(strong, 0.75).otherwise(0.6), F.when(strong, 18).otherwise(12),
                         F.concat(h["keyword"], F.lit(": "), shown), u["path"], F.when(u["line_number"] > 0, u["line_number"]), shown)

    found = F.slice(F.filter(F.transform(asked, place), lambda h: h["u"].isNotNull()), 1, 20)
    return F.when(F.col("brand.name").isNotNull(), F.transform(found, made))


@rule("suspicious-destination", "Suspicious Data Destination")
def _destination(as_of: Column) -> Column:
    names = F.concat(F.array("brand.name"), F.coalesce("brand.aliases", F.array().cast("array<string>")))
    slugs = F.filter(F.transform(names, extract.slug), lambda s: F.length(s) >= extract.SHORTEST_SLUG)
    own = F.transform(
        F.concat(
            F.coalesce("brand.aliases", F.array().cast("array<string>")),
            F.coalesce("brand.keywords", F.array().cast("array<string>")),
        ),
        lambda c: F.lower(F.trim(c)),
    )
    readme = F.array(
        F.struct(
            F.coalesce("readme_path", F.lit("README.md")).alias("path"),
            F.coalesce("readme_text", F.lit("")).alias("content"),
        )
    )
    texts = F.concat(
        readme, F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["content"].alias("content")))
    )

    def urls(f: Column) -> Column:
        hits = F.concat(*(F.regexp_extract_all(f["content"], F.lit(p), F.lit(1)) for p in K.DESTINATIONS))
        return F.transform(
            hits, lambda u: F.struct(extract.host(u).alias("host"), u.alias("url"), f["path"].alias("path"))
        )

    def foreign(h: Column) -> Column:
        labels = F.transform(F.split(h["host"], r"\."), lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))
        return h["host"].isNotNull() & ~h["host"].isin(*K.BENIGN_HOSTS) & ~F.array_contains(
            own, h["host"]
        ) & ~F.arrays_overlap(labels, slugs)

    found = F.filter(F.flatten(F.transform(texts, urls)), foreign)
    hosts = F.transform(found, lambda h: h["host"])
    found = F.slice(F.filter(found, lambda h, i: F.array_position(hosts, h["host"]) == i + 1), 1, 5)
    made = lambda h: detection(
        "suspicious-destination",
        "suspicious_destination",
        "high",
        0.7,
        25,
        F.concat(F.lit("sends data to "), h["host"]),
        h["path"],
        None,
        h["url"],
    )
    return F.when(F.col("brand.name").isNotNull(), F.transform(found, made))


@rule("deployment-signal", "Deploy Configuration Present")
def _deployment(as_of: Column) -> Column:
    found = extract.deploy_configs(F.col("file_paths"))
    return one(
        F.col("brand.name").isNotNull() & (F.size(found) > 0),
        detection("deployment-signal", "suspicious_destination", "low", 0.5, 8, F.array_join(found, ", ")),
    )


#: Shapes of secrets: id, small letters that every match has one of, pattern, severity. A family of its own, which
#: reads like the redaction's.
SECRET_SHAPES = (
    ("aws-access-key", ("akia",), r"AKIA[0-9A-Z]{16}", "critical"),
    ("code-host-token", ("ghp_", "github_pat_"), r"ghp_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}", "critical"),
    ("private-key", ("private key",), r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----", "critical"),
    ("jwt", ("eyj",), r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "medium"),
    ("cloud-api-key", ("aiza",), r"AIza[0-9A-Za-z_-]{35}", "high"),
    ("payment-live-key", ("sk_live_",), r"sk_live_[A-Za-z0-9]{20,}", "critical"),
    ("chat-token", ("xox",), r"xox[baprs]-[A-Za-z0-9-]{10,}", "high"),
    ("model-api-key", ("sk-ant-",), r"sk-ant-[A-Za-z0-9_-]{20,}", "high"),
    ("mail-api-key", ("sg.",), r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", "high"),
    (
        "database-address",
        ("://",),
        r"""(?i)(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql)://[^\s"'<>:@]+:[^\s"'<>@]+@[^\s"'<>]+""",
        "critical",
    ),
)
GENERIC_ANCHORS = ("api", "token", "secret", "password")
GENERIC_SECRET = r"""(?i)(?:api[_-]?key|token|secret|password)\s*[:=]\s*['"]?([^\s'"]{8,})['"]?"""


def secret_anchored(line: Column) -> Column:
    """Whether a line may have a secret: one of the anchors, which are far cheaper to find than the patterns."""
    anchors = {a for _, some, _, _ in SECRET_SHAPES for a in some} | set(GENERIC_ANCHORS)
    return T.any_of(F.lower(line), tuple(sorted(anchors)))


def secret_matches(line: Column) -> Column:
    """Structs (pattern_id, severity, value) of a line's secrets; placeholders and references to code don't count."""
    low, none = F.lower(line), F.array().cast("array<string>")

    def hits(anchors: tuple[str, ...], pattern: str, group: int) -> Column:
        return F.when(T.any_of(low, anchors), F.regexp_extract_all(line, F.lit(pattern), F.lit(group))).otherwise(none)

    def match(identity: str, severity: str):
        return lambda v: F.struct(
            F.lit(identity).alias("pattern_id"), F.lit(severity).alias("severity"), v.alias("value")
        )

    found = [F.transform(hits(some, p, 0), match(i, s)) for i, some, p, s in SECRET_SHAPES]
    shaped = F.filter(F.concat(*found), lambda m: ~secrets.is_placeholder(m["value"]))
    values = F.transform(shaped, lambda m: m["value"])

    def loose(v: Column) -> Column:
        known = F.exists(values, lambda s: F.contains(s, v) | F.contains(v, s))
        return secrets.is_high_entropy(v, 16, 3.0) & ~known

    generic = F.filter(hits(GENERIC_ANCHORS, GENERIC_SECRET, 1), loose)
    return F.concat(shaped, F.transform(generic, match("generic-assignment", "medium")))


def analysed(
    context: DataFrame,
    as_of: Column,
    excluded: tuple[str, ...] = (),
    internal_audit: bool = False,
) -> DataFrame:
    """Rows (repo_id, ord, rule_id, ...) of all rules over a context table, as of a time."""
    skipped = set(excluded) | (set(K.IMPERSONATION_ONLY_RULES) if internal_audit else set())
    ready = context.withColumns({"_text": whole_text(), "_units": units.unit_columns()})
    # columns that several expressions of a rule read are computed once a row, in a projection of their own
    ready = ready.withColumns({"_branded": brand_named(), "_lures": named_lures()})
    terms = F.array_distinct(F.flatten(F.transform("_lures", lambda h: h["terms"])))
    ready = ready.withColumn("_lure_terms", terms)
    empty = F.array().cast(f"array<{DETECTION}>")
    found = F.concat(
        *(F.coalesce(r.found(as_of).cast(f"array<{DETECTION}>"), empty) for r in RULES.values() if r.id not in skipped)
    )
    return ready.select("repo_id", F.posexplode(found).alias("ord", "d")).select("repo_id", "ord", "d.*")


def ruleset_version() -> Column:
    return H.ruleset_version(F.lit(VERSION), F.array(*map(F.lit, sorted(RULES))))


def credential_reuse(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates(repo_id, brand_id, value, path, line_number) whose value's hash the brand is known to have."""
    rows = candidates.withColumn("value_hash", H.known_value(F.col("value")))
    return rows.join(known.select("brand_id", "value_hash").distinct(), ["brand_id", "value_hash"], "left_semi").drop(
        "value"
    )


def phrase_reuse(lines: DataFrame, phrases: DataFrame, most: int = 10) -> DataFrame:
    """Rows (repo_id, phrase_id, path, line_number, turn): the first line of each file that has a known phrase, `most` a repository.

    lines(repo_id, path, line_number, line) and phrases(phrase_id, text) meet on a word: the
    longest word of a phrase must be a word of the line, so neither side is paired with all of the other.
    """
    words = F.regexp_extract_all(F.lower("line"), F.lit(r"[^\s]+"), F.lit(0))
    asked = phrases.select("phrase_id", F.lower("text").alias("low")).withColumn("parts", F.split("low", " "))
    inner = F.slice("parts", 2, F.greatest(F.size("parts") - 2, F.lit(1)))
    longest = F.array_max(
        F.transform(
            F.when(F.size("parts") > 2, inner).otherwise(F.col("parts")), lambda w: F.struct(F.length(w), w.alias("w"))
        )
    )
    whole = asked.where("size(parts) > 2").withColumn("key", longest["w"])
    rows = lines.select("repo_id", "path", "line_number", "line", F.explode(F.array_distinct(words)).alias("key"))
    found = rows.join(whole, "key").where(F.contains(F.lower("line"), F.col("low")))
    short = asked.where("size(parts) <= 2")
    found = found.select("repo_id", "path", "line_number", "phrase_id").unionByName(
        lines.join(short, F.contains(F.lower("line"), F.col("low"))).select("repo_id", "path", "line_number", "phrase_id")
    )
    first = found.groupBy("repo_id", "phrase_id", "path").agg(F.min("line_number").alias("line_number"))
    from pyspark.sql.window import Window

    turn = F.row_number().over(Window.partitionBy("repo_id").orderBy("phrase_id", "path"))
    return first.withColumn("turn", turn).where(F.col("turn") <= most)


def file_reuse(files: DataFrame, known: DataFrame, shortest: int = 200, most: int = 10) -> DataFrame:
    """files whose normalised content is a known one, of 200 bytes or more, `most` a repository."""
    from pyspark.sql.window import Window

    rows = files.where(F.octet_length("content") >= shortest).withColumn(
        "content_hash", H.content_hash(F.col("content"))
    )
    found = rows.join(known.select("content_hash").distinct(), "content_hash", "left_semi")
    turn = F.row_number().over(Window.partitionBy("repo_id").orderBy("path"))
    return found.select("repo_id", "path", "content_hash").withColumn("turn", turn).where(F.col("turn") <= most)


def chunk_overlap(left: DataFrame, right: DataFrame, key: str, other: str, hashes: str = "hashes") -> DataFrame:
    """Rows (key, other, shared, containment) of two tables of winnowed fingerprints; an addition to the rules."""
    a = left.select(key, F.size(hashes).alias("n"), F.explode(hashes).alias("h"))
    b = right.select(other, F.explode(hashes).alias("h"))
    shared = a.join(b, "h").groupBy(key, other).agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return shared.select(key, other, "shared", (F.col("shared") / F.col("n")).alias("containment"))


def live_destinations(destinations: DataFrame, liveness: DataFrame, detections: DataFrame, most: int = 3) -> DataFrame:
    """Destinations that answered with a status below 500, of repositories with more than reputation signals.

    liveness(url, status) is collected elsewhere: the engine itself reaches no network.
    """
    real = detections.where("rule_id <> 'low-reputation-new-repo'").select("repo_id").distinct()
    rows = destinations.where(F.col("turn") <= most).join(real, "repo_id", "left_semi").join(liveness, "url")
    return rows.where("status < 500").select(
        "repo_id",
        "hostname",
        "url",
        "status",
        F.lit("critical").alias("severity"),
        F.lit(0.9).alias("confidence"),
        F.lit(30.0).alias("risk_contribution"),
    )
