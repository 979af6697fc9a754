"""What a path says about a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import constants as K


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.lower(path), "/", -1), -1)


def is_excluded(path: Column) -> Column:
    """Whether a segment of the path is a folder that scans leave out."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, K.EXCLUDED_DIRS)))


def is_binary_or_large(content: Column, size: Column, most: int) -> Column:
    return (size > most) | (F.position(F.lit("\0"), F.substring(content, 1, 512)) > 0)


def is_text(path: Column) -> Column:
    return path.rlike(K.TEXT_FILE)


def is_readme(path: Column) -> Column:
    return basename(path).rlike(K.DOCS_FILE)


def priority(path: Column, aliases: Column | None = None) -> Column:
    """How much a path deserves to be read, 100 to 0; the first branch that holds counts."""
    p, name = F.lower(path), basename(path)
    branded = F.lit(False) if aliases is None else is_text(p) & F.exists(
        aliases, lambda a: (F.length(a) > 0) & F.contains(p, F.lower(a))
    )
    branches = (
        ((name == ".env") | name.startswith(".env."), 100),
        (name.isin("credentials.json", "secrets.json", "serviceaccount.json", "service-account.json"), 93),
        (name.isin("firebase.json", "google-services.json", ".firebaserc"), 92),
        (p.rlike(r"\.(pem|key|jks|p12|pfx)$|id_rsa|id_ed25519"), 95),
        (p.rlike("credential|secret|password"), 90),
        (name.isin(".npmrc", ".pypirc", "netrc"), 88),
        (branded, 82),
        (name.isin("docker-compose.yml", "docker-compose.yaml", "package.json", "package-lock.json", "requirements.txt", "pom.xml",
                   "build.gradle", "gradle.properties"), 85),
        (name.endswith(".tfvars"), 84),
        ((name == "dockerfile") | name.startswith("dockerfile."), 80),
        (name.isin("appsettings.json", "config.json"), 78),
        (F.contains(p, F.lit(".github/workflows/")), 75),
        (name.startswith("readme"), 70),
        (p.rlike(r"\.(properties|json|yml|yaml)$"), 60),
        (is_text(p), 40),
    )
    out = F.when(branches[0][0], branches[0][1])
    for condition, score in branches[1:]:
        out = out.when(condition, score)
    return out.otherwise(0)


def content_kind(path: Column) -> Column:
    """locale, template, legal or docs for a file of prose, null for others and for boilerplate."""
    p, name = F.lower(path), basename(path)
    return (
        F.when(name.isin(*K.BOILERPLATE_FILES), None).when(p.rlike(K.LOCALE_PATH) | name.rlike(K.LOCALE_FILE), "locale")
        .when(p.rlike(K.TEMPLATE_PATH), "template").when(name.rlike(K.LEGAL_FILE), "legal").when(name.rlike(K.DOCS_FILE) | p.rlike(K.PROSE_PATH), "docs")
    )


def sampled(files: DataFrame, most: int, aliases: Column | None = None, by: str = "repo_id") -> DataFrame:
    """The `most` files of each repository to read: text files by priority and path, then others in tree order."""
    score = priority(F.col("path"), aliases)
    ranked = is_text(F.col("path")) & (score > 0)
    rows = files.withColumn("priority", score).withColumn("_ranked", ranked)
    order = Window.partitionBy(by).orderBy(
        F.desc("_ranked"), F.desc(F.when(F.col("_ranked"), F.col("priority"))), F.when(F.col("_ranked"), F.col("path")), "ord"
    )
    return rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("_ranked")


def capped(files: DataFrame, most: int, by: str) -> DataFrame:
    """The first `most` paths of each group by code point."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy("path"))
    return files.withColumn("turn", turn).where(F.col("turn") <= most)


def safe_branch(branch: Column) -> Column:
    return branch.rlike(r"^(?!-)(?!.*\.\.)[A-Za-z0-9._/-]{1,250}$")


def within_budget(parts: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """parts with `taken`, the head of each text that a budget of characters leaves, in order; empty ones go."""
    before = F.coalesce(
        F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    left = F.greatest(F.lit(0), F.lit(budget) - before)
    return parts.withColumn("taken", F.substr(text, F.lit(1), left.cast("int"))).where(F.length("taken") > 0)
