"""Search queries for brands: families of them in a fixed order, without repeats and within a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import constants as K
from siltworks.functions import dates
from siltworks.operators import views

LONGEST_QUERY, MOST_KEYWORDS, MOST_PHRASES, MOST_VARIANTS, SPLIT_AT = 250, 100, 5, 3, 950
FALLBACK = {"phishing": ("phishing", "login"), "malware": ("apk", "stealer"), "secret": ("AKIA", "ghp_"), "brand": ()}


def variants(term: Column, most: int = 8) -> Column:
    """Names that imitate a term: with a lure, and misspelled; in this order, so few misspelled ones are left below 16."""
    base = F.regexp_replace(F.lower(term), "[^a-z0-9]", "")
    lures = [F.concat(base, F.lit(sep + s)) for s in K.LURE_SUFFIXES for sep in ("-", "")]
    digits = F.translate(base, "oea", "034")
    half = F.floor(F.length(base) / 2).cast("int")
    char = lambda k: F.substr(base, k + 1, F.lit(1))
    head, long = F.substr(base, F.lit(1), half), F.length(base) > 4
    dropped = F.when(long, F.concat(head, F.substr(base, half + 2)))
    swapped = F.when(long, F.concat(head, char(half + 1), char(half), F.substr(base, half + 3)))
    every = F.array_distinct(F.array_compact(F.array(*lures, digits, F.concat(base, F.lit("e")), dropped, swapped)))
    kept = F.slice(F.filter(every, lambda v: (F.length(v) >= 4) & (v != base)), 1, most)
    return F.when(F.length(base) >= 3, kept).otherwise(F.array().cast("array<string>"))


def phrase(term: Column) -> Column:
    return F.when(F.contains(term, F.lit(" ")), F.concat(F.lit('"'), term, F.lit('"'))).otherwise(term)


def picked(keywords: DataFrame, spark: SparkSession) -> dict[str, list[str]]:
    """The first keywords of each category of a short, analyst-kept list, which the driver reads."""
    rows = keywords if keywords.where("enabled").take(1) else spark.createDataFrame(
        list(K.FALLBACK_KEYWORDS), "keyword string, category string, priority int"
    ).withColumn("enabled", F.lit(True))
    out: dict[str, list[str]] = {}
    for r in views.top_keywords(rows, 6).orderBy("category", "turn").collect():
        out.setdefault(r.category, []).append(r.keyword)
    return out


def query_families(
    brands: DataFrame, keywords: DataFrame, phrases: DataFrame | None = None, *, most: int = 40, code: bool = True, secret_files: bool = True,
    date_suffixes: tuple[str, ...] = ("",), scoped: bool = False, only_keyword: str | None = None, scope: str = "both",
) -> DataFrame:
    """Rows (ord, family, kind, query) of brands(brand_id, brand_name, keywords, trusted_owners) in order of brand.

    A repository query comes once for each date suffix; a code query also searches forks. Of
    equal queries the first stays, those over 250 characters go, and `most` stay in all.
    phrases(brand_id, text, turn) add searches for a brand's own wording.
    """
    spark = brands.sparkSession
    best = picked(keywords, spark)
    some = lambda category, n: (best.get(category) or list(FALLBACK[category]))[:n]
    term = F.trim(
        F.coalesce(
            F.when(F.length(F.get("keywords", F.lit(0))) > 0, F.get("keywords", F.lit(0))), "brand_name", F.lit("")
        )
    )
    rows = brands.withColumn("term", F.substring(F.replace(term, F.lit('"'), F.lit("")), 1, 40)).where(
        F.length("term") > 0
    )
    t, p = F.col("term"), phrase(F.col("term"))
    lit = F.lit
    spec = lambda family, kind, query, k=0: F.struct(
        lit(k).cast("int").alias("part"), lit(family).alias("family"), lit(kind).alias("kind"), query.alias("query")
    )
    many = lambda family, kind, array, make: F.transform(array, lambda v, i: F.struct(
        i.cast("int").alias("part"), lit(family).alias("family"), lit(kind).alias("kind"), make(v).alias("query")
    ))
    named = lambda words: F.concat(p, lit(f" ({' OR '.join(words)}) in:name,description"))
    none = F.array().cast("array<string>")
    clean = F.transform(
        F.coalesce("keywords", none), lambda k: F.substring(F.trim(F.replace(k, lit('"'), lit(""))), 1, 100)
    )
    low = F.transform(clean, lambda k: F.lower(k))
    own = F.filter(
        clean,
        lambda k, i: (F.length(k) > 0) & (F.lower(k) != F.lower(t)) & (F.array_position(low, F.lower(k)) == i + 1),
    )
    own = F.slice(own, 1, MOST_KEYWORDS)
    if only_keyword is not None:
        k = only_keyword.replace('"', "").strip()[:100]
        same = F.lower(t) == k.lower()
        groups = []
        if k and scope != "code":
            groups.append(
                F.array(spec("brand-keyword-custom", "repositories", F.when(same, p).otherwise(phrase(lit(k)))))
            )
        if k and code and scope != "repositories":
            groups.append(
                F.array(
                    spec(
                        "brand-keyword-custom-code",
                        "code",
                        F.concat(lit('"'), F.when(same, t).otherwise(lit(k)), lit('"')),
                    )
                )
            )
    else:
        quoted = lambda v: F.concat(lit('"'), t, lit('" "'), v, lit('"'))
        where = lambda v: F.when(F.contains(v, lit("/")), " in:description").otherwise(
            " in:name,description"
        )
        owners = F.filter(
            F.transform(
                F.coalesce("trusted_owners", none), lambda o: F.substring(F.regexp_replace(o, r'["\s]', ""), 1, 40)
            ),
            lambda o: F.length(o) > 0,
        )
        sides = F.flatten(F.transform(owners, lambda o: F.array(F.concat(lit("org:"), o), F.concat(lit("user:"), o))))
        groups = [
            F.array(spec("phishing", "repositories", named(some("phishing", 4)))), F.array(spec("apk", "repositories", named(some("malware", 4)))),
            F.array(spec("impersonation", "repositories", named(["clone", "spoof", "fake", "unofficial"]))),
            many("typo-squat", "repositories", variants(t, MOST_VARIANTS), lambda v: F.concat(v, lit(" in:name"))),
            many("brand-keyword-custom", "repositories", own, lambda v: F.concat(p, lit(' "'), v, lit('"'), where(v))),
        ]
        if code:
            groups.append(
                F.array(
                    spec("brand-secret", "code", F.concat(lit('"'), t, lit(f'" ({" OR ".join(some("secret", 4))})')))
                )
            )
            groups.append(many("brand-keyword-custom-code", "code", own, quoted))
            if phrases is not None:
                said = phrases.where(F.col("turn") <= MOST_PHRASES).groupBy("brand_id").agg(
                    F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said")
                )
                rows = rows.join(said, "brand_id", "left")
                texts = F.filter(
                    F.transform(
                        F.coalesce("said", F.array().cast("array<struct<turn:int,text:string>>")),
                        lambda s: F.trim(F.replace(s["text"], lit('"'), lit(""))),
                    ),
                    lambda s: F.length(s) > 0,
                )
                groups.append(many("distinctive-content", "code", texts, lambda v: F.concat(lit('"'), v, lit('"'))))
        groups.append(many("trusted-account", "repositories", sides, lambda v: v))
    specs = rows.select(
        F.col("brand_id").cast("long").alias("brand"), F.posexplode(F.array(*groups)).alias("group", "g")
    ) if groups else None
    specs = specs.select("brand", "group", F.inline("g"))
    tail = []
    if not scoped and only_keyword is None:
        tail += [
            ("brand-keyword", "repositories", f"{k} (login OR apk OR phishing) in:name,description")
            for k in some("brand", 5)
        ]
    if secret_files and not scoped:
        if code:
            tail += [("secret-filename", "code", q) for q in K.SECRET_FILE_QUERIES] + [
                ("secret-filename", "code", f"filename:.env {k}")
                for k in best.get("secret", [])[:6]
            ]
        else:
            terms = (best.get("secret") or ["dotenv", "credentials", "private key"])[:5]
            tail += [("secret-filename", "repositories", f"{' OR '.join(terms)} in:name,description")]
    if tail:
        last = spark.createDataFrame(
            [(1 << 60, 0, i, *r) for i, r in enumerate(tail)],
            "brand long, `group` int, part int, family string, kind string, query string",
        )
        specs = specs.unionByName(last)
    return _capped(specs, date_suffixes, most)


def _capped(specs: DataFrame, suffixes: tuple[str, ...], most: int) -> DataFrame:
    dated = F.array(*(F.lit(s) for s in suffixes))
    each = F.when(F.col("kind") == "code", F.array(F.lit(" fork:true"))).otherwise(dated)
    rows = specs.select(
        "brand", "group", "part", "family", "kind", "query", F.posexplode(each).alias("suffix_ord", "suffix")
    )
    rows = rows.withColumn("query", F.concat("query", "suffix")).where(F.length("query") <= LONGEST_QUERY)
    first = rows.groupBy("kind", "query").agg(
        F.min(F.struct("brand", "group", "part", "suffix_ord", "family")).alias("f")
    )
    first = first.orderBy("f").limit(most)
    return first.select((F.row_number().over(Window.orderBy("f")) - 1).alias("ord"), "f.family", "kind", "query")


def preview(families: DataFrame) -> DataFrame:
    """One row: the first query of each kind of a keyword's families, '' if there is none."""
    first = lambda kind: F.coalesce(
        F.min_by(F.when(F.col("kind") == kind, F.col("query")), F.when(F.col("kind") == kind, F.col("ord"))), F.lit("")
    )
    return families.agg(first("repositories").alias("repo_query"), first("code").alias("code_query"))


def splits(queries: DataFrame, by: str = "language", deepest: int = 7) -> DataFrame:
    """Rows (query, part, into, depth) of queries(query, total, page, depth): what an oversized one is replaced by.

    Only the first page of a search with 950 hits or more is split, size ranges up to 7 and
    dates up to 10 times; a language split is made once.
    """
    most = {"language": 1, "size": deepest, "created": 10}[by]
    rows = queries.where((F.col("total") >= SPLIT_AT) & (F.col("page") == 1) & (F.col("depth") < most))
    halves = {
        "language": lambda q: dates.by_language(q), "size": lambda q: dates.halved_size(dates.bounded(q, "size")), "created": lambda q: dates.halved_created(dates.bounded(q))
    }[by](F.col("query"))
    return rows.withColumn("_h", halves).where("_h is not null").select(
        "query", F.posexplode("_h").alias("part", "into"), (F.col("depth") + 1).alias("depth")
    )
