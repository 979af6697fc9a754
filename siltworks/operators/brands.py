"""Which brand a repository is about, and where that shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import text as T
from siltworks.operators import units

STRENGTH = {"trusted_owner": 3, "exact": 2, "fuzzy": 1}
KEYWORDS_SHOWN = 5


def _aliases() -> Column:
    names = F.concat(F.array("brand_name"), F.col("aliases"))
    return F.filter(F.transform(names, lambda a: F.lower(a)), lambda a: F.length(a) > 0)


def evidence(
    units_rows: DataFrame,
    repos: DataFrame,
    brands: DataFrame,
    exact_only: bool = False,
    grep_hits: DataFrame | None = None,
) -> DataFrame:
    """Rows (repo_id, brand_id, type, rank, entry, line_number, alias, matched, path): the best proof of each brand.

    A trusted owner comes first; then the first unit, in order of location, entry and line,
    that has an alias as a word; where there is none, the first with a word that resembles an
    alias. grep_hits(repo_id, path, line_number, term, line, ord) come before other contents.
    Brands(brand_id, brand_name, aliases, trusted_owners) are a list kept by analysts; whether it
    is broadcast is left to the planner, which knows its size.
    """
    known = brands.select("brand_id", _aliases().alias("names"))
    owners = brands.select(
        "brand_id", F.explode(F.array_distinct(F.transform("trusted_owners", lambda o: F.lower(o)))).alias("_o")
    )
    owned = repos.select("repo_id", "owner").join(owners, F.lower("owner") == F.col("_o"))
    owned = owned.select("repo_id", "brand_id", F.lit("trusted_owner").alias("type"), F.struct(
        F.lit(-1).alias("rank"), F.lit(0).alias("entry"), F.lit(0).alias("line_number"), F.lit(0).alias("word"), F.lower("owner").alias("alias"),
        F.col("owner").alias("matched"), F.lit(None).cast("string").alias("path")).alias("proof"))
    hit = T.first_alias(F.col("text"), F.col("names"))
    exact = units_rows.join(known, F.exists("names", lambda a: F.contains(F.lower("text"), a))).withColumn(
        "hit", hit
    ).where("hit is not null")
    exact = exact.select("repo_id", "brand_id", F.struct(
        "rank", "entry", "line_number", F.lit(0).alias("word"), F.col("hit.alias").alias("alias"),
        T.snippet(F.col("text"), F.col("hit.at"), F.length("hit.alias")).alias("matched"), "path").alias("proof"))
    if grep_hits is not None:
        near = grep_hits.join(known, F.expr("array_contains(names, lower(term))"))
        at = F.position(F.lower("term"), F.lower("line")) - 1
        exact = exact.unionByName(near.select("repo_id", "brand_id", F.struct(
            F.lit(units.LOCATIONS.index("file_content")).alias("rank"), F.lit(0).alias("entry"), "line_number", F.lit(0).alias("word"), F.col("term").alias("alias"),
            T.snippet(F.col("line"), at, F.length("term")).alias("matched"), "path").alias("proof")))
    exact = exact.groupBy("repo_id", "brand_id").agg(F.min("proof").alias("proof")).withColumn("type", F.lit("exact"))
    found = owned.unionByName(exact)
    if not exact_only:
        found = found.unionByName(_fuzzy(units_rows, known, found.select("repo_id", "brand_id").distinct()))
    best = Window.partitionBy("repo_id", "brand_id").orderBy(F.desc(_strength()))
    found = found.withColumn("_turn", F.row_number().over(best)).where("_turn = 1")
    return found.select(
        "repo_id",
        "brand_id",
        "type",
        "proof.rank",
        "proof.entry",
        "proof.line_number",
        "proof.alias",
        "proof.matched",
        "proof.path",
    )


def _strength() -> Column:
    out = F.lit(0)
    for kind, n in STRENGTH.items():
        out = F.when(F.col("type") == kind, n).otherwise(out)
    return out


def _fuzzy(units_rows: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """The first word that resembles an alias of each brand that a repository has no other proof of.

    Words travel without the texts they are in; only the texts of first hits are fetched again.
    """
    place = ["repo_id", "rank", "entry", "line_number"]
    words = units_rows.select(*place, F.posexplode(T.tokens(F.col("text"))).alias("word", "token"))
    names = known.select("brand_id", F.posexplode("names").alias("alias_ord", "alias"))
    alike = T.fuzzy_pairs(words, names).select("token", "alias")
    hits = words.join(alike, "token").join(names, "alias").join(found, ["repo_id", "brand_id"], "left_anti")
    first = hits.groupBy("repo_id", "brand_id").agg(
        F.min(F.struct(*place[1:], "word", "alias_ord", "alias", "token")).alias("f")
    )
    first = first.select("repo_id", "brand_id", "f.*").join(units_rows, place)
    at = F.position(F.col("token"), F.lower("text")) - 1
    proof = F.struct(
        "rank",
        "entry",
        "line_number",
        "word",
        "alias",
        T.snippet(F.col("text"), at, F.length("token")).alias("matched"),
        "path",
    )
    return first.select("repo_id", "brand_id", proof.alias("proof"), F.lit("fuzzy").alias("type"))


def best_brand(proofs: DataFrame, brands: DataFrame) -> DataFrame:
    """The brand of each repository whose proof is strongest by place, then by kind; ties keep the earlier brand."""
    strong = (F.col("rank") <= units.LOCATIONS.index("file_path")).cast("int")
    order = Window.partitionBy("repo_id").orderBy(F.desc(strong), F.desc(_strength()), "brand_id")
    return proofs.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn").join(
        brands.select("brand_id", "brand_name"), "brand_id"
    )


def keyword_matches(
    units_rows: DataFrame,
    repos: DataFrame,
    keywords: DataFrame,
    most: int = KEYWORDS_SHOWN,
) -> DataFrame:
    """The first `most` keywords(ord, keyword), in their order, that a repository has, with the first place of each."""
    as_brands = T.first_spellings(keywords, "keyword", "ord").select(
        F.col("ord").alias("brand_id"), F.col("keyword").alias("brand_name"), F.array().cast("array<string>").alias("aliases"),
        F.array().cast("array<string>").alias("trusted_owners"),
    )
    proofs = evidence(units_rows, repos, as_brands, exact_only=True).withColumnRenamed("brand_id", "ord")
    turn = F.row_number().over(Window.partitionBy("repo_id").orderBy("ord"))
    return proofs.withColumn("turn", turn).where(F.col("turn") <= most)


#: Letters at an alias's beginning by which texts that may contain it are found; apart in length that a likeness may be.
HEAD, SHALLOW_APART = 3, 12


def _heads(text: Column, most: int = HEAD) -> Column:
    """All runs of `most` characters of a text, and its shorter ones."""
    runs = [
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - k + 1)), _run(text, k))
        for k in range(1, most + 1)
    ]
    return F.array_distinct(F.concat(*runs))


def _run(text: Column, size: int):
    return lambda at: F.substr(text, at, F.lit(size))


def shallow_brand(repos: DataFrame, brands: DataFrame) -> DataFrame:
    """repos with brand_id: that of a trusted owner, else the first whose alias the name, description or topics contain or resemble.

    All joins are on keys: owners, the first letters of an alias, the length of a text.
    """
    text = F.lower(F.concat_ws(" ", "full_name", F.coalesce("description", F.lit("")), F.array_join("topics", " ")))
    rows = repos.select("repo_id", F.lower("owner").alias("o"), text.alias("t"))
    names = brands.select("brand_id", F.explode(_aliases()).alias("a"))
    owners = brands.select("brand_id", F.explode(F.transform("trusted_owners", lambda o: F.lower(o))).alias("o"))
    late = lambda v: F.struct(F.lit(v).alias("late"), "brand_id").alias("k")
    trusted = rows.join(owners, "o").select("repo_id", late(False))
    by_head = names.withColumn("h", F.substring("a", 1, HEAD))
    contained = rows.select("repo_id", "t", F.explode(_heads(F.col("t"))).alias("h")).join(by_head, "h")
    contained = contained.where(F.contains("t", F.col("a"))).select("repo_id", late(True))
    near = F.explode(F.sequence(F.length("a") - SHALLOW_APART, F.length("a") + SHALLOW_APART)).alias("n")
    pairs = rows.select("repo_id", "t", F.length("t").alias("n")).join(names.select("brand_id", "a", near), "n")
    alike = T.resembling(pairs, "t", "a").select("repo_id", late(True))
    found = trusted.unionByName(contained).unionByName(alike).groupBy("repo_id").agg(F.min("k").alias("k"))
    return repos.join(found, "repo_id", "left").withColumn("brand_id", F.col("k.brand_id")).drop("k")


def discovery_evidence(
    kind: Column,
    path: Column,
    name: Column,
    description: Column,
    topics: Column,
    keyword: Column,
) -> Column:
    """Struct (field, text) that tells why a search found a repository; null if nothing does."""
    low = F.lower(keyword)
    joined = F.array_join(topics, ", ")
    found = lambda field, t: F.when(
        T.word_index(F.coalesce(t, F.lit("")), low) >= 0, F.struct(F.lit(field).alias("field"), t.alias("text"))
    )
    code = F.when(kind == "code", F.struct(F.lit("file_content").alias("field"), path.alias("text")))
    return F.coalesce(code, found("name", name), found("description", description), found("topics", joined))
