"""Contacts, addresses and phrases that texts hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.functions import constants as K
from siltworks.functions import text as T

MOST_DESTINATIONS, SHORTEST_SLUG = 8, 4
SHORTEST_PHRASE, LONGEST_PHRASE, LEAST_WORDS, SHORTEST_WORD = 12, 200, 3, 4


def is_placeholder_email(email: Column) -> Column:
    domain = F.coalesce(F.get(F.split(email, "@"), F.lit(1)), F.lit(""))
    return email.isin(*K.PLACEHOLDER_EMAILS) | domain.rlike(K.PLACEHOLDER_DOMAIN)


def _named(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))


def contacts(text: Column) -> Column:
    """Array of structs (kind, value): who a text can be traced to, each once, wallets in their own spelling.

    A pattern is only searched in texts that have what each of its matches has.
    """
    found, low = [], F.lower(text)
    for (kind, pattern, group), anchors in zip(K.CONTACTS, K.CONTACT_ANCHORS, strict=True):
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        if anchors:
            hits = F.when(T.any_of(low, anchors), hits).otherwise(F.array().cast("array<string>"))
        if kind != "crypto_wallet":
            hits = F.transform(hits, lambda v: F.lower(v))
        if kind == "email":
            hits = F.filter(hits, lambda v: ~is_placeholder_email(v))
        found.append(F.transform(hits, _named(kind)))
    return F.when(text.isNotNull(), F.array_distinct(F.concat(*found)))


def host(url: Column) -> Column:
    """Lower-cased host of an http(s) address, null if it is none."""
    return F.when(url.rlike(r"(?i)^https?://"), F.lower(F.try_parse_url(url, F.lit("HOST"))))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]", "")


def _placed(pattern: int):
    return lambda u, i: F.struct(F.lit(pattern).alias("pattern"), i.alias("place"), u.alias("url"))


def destinations(
    files: DataFrame,
    names: Column | None = None,
    own_hosts: Column | None = None,
    most: int = MOST_DESTINATIONS,
) -> DataFrame:
    """Rows (repo_id, hostname, url, source, turn) of files(repo_id, ord, path, content): where code sends data.

    The first `most` hosts of a repository, in the order of file, pattern and place, without
    harmless ones, those in own_hosts, and those of which a label is a brand's name.
    """
    hits = F.concat(*(
        F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(1)), _placed(k))
        for k, p in enumerate(K.DESTINATIONS)
    ))
    slugs = F.filter(
        F.transform(names if names is not None else F.array().cast("array<string>"), slug),
        lambda s: F.length(s) >= SHORTEST_SLUG,
    )
    own = own_hosts if own_hosts is not None else F.array().cast("array<string>")
    rows = files.select(
        "repo_id",
        "ord",
        F.col("path").alias("source"),
        slugs.alias("slugs"),
        own.alias("own"),
        F.explode(hits).alias("h"),
    )
    rows = rows.withColumn("hostname", host(F.col("h.url"))).where(
        F.col("hostname").isNotNull() & ~F.col("hostname").isin(*K.BENIGN_HOSTS)
    )
    labels = F.transform(F.split("hostname", r"\."), lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))
    rows = rows.where(~F.array_contains("own", F.col("hostname")) & ~F.arrays_overlap(labels, "slugs"))
    first = rows.groupBy("repo_id", "hostname").agg(
        F.min(F.struct("ord", "h.pattern", "h.place", "h.url", "source")).alias("f")
    )
    turn = F.row_number().over(Window.partitionBy("repo_id").orderBy("f"))
    return first.withColumn("turn", turn).where(F.col("turn") <= most).select(
        "repo_id", "hostname", "f.url", "f.source", "turn"
    )


def deploy_configs(paths: Column) -> Column:
    """The deploy configurations among paths, in the order of the list of them."""
    def ends(name: str):
        return lambda p: (p == name) | p.endswith(f"/{name}")

    return F.array_compact(F.array(*(F.when(F.exists(paths, ends(c)), F.lit(c)) for c in K.DEPLOY_CONFIGS)))


def is_private_ipv4(ip: Column) -> Column:
    """Whether an address is in a private, loopback, link-local or zero network; false if malformed."""
    parts = F.transform(F.split(ip, r"\.", -1), lambda p: p.try_cast("int"))
    ok = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull() & (p >= 0) & (p <= 255))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    private = a.isin(127, 10, 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (
        (a == 169) & (b == 254)
    )
    return F.coalesce(ok & private, F.lit(False))


def segments(text: Column) -> Column:
    """Quoted strings of each line, without quotes, or the line where there is none."""
    quoted = r""""(?:[^"\\]|\\.){3,300}"|'(?:[^'\\]|\\.){3,300}'"""

    def of(line: Column) -> Column:
        hits = F.regexp_extract_all(line, F.lit(quoted), F.lit(0))
        inner = F.transform(hits, lambda h: F.substr(h, F.lit(2), F.length(h) - 2))
        return F.when(F.size(hits) > 0, inner).otherwise(F.array(line))

    return F.flatten(F.transform(T.lines(text), of))


def significant_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))
    return F.size(F.filter(words, lambda w: (F.length(w) >= SHORTEST_WORD) & ~w.isin(*K.STOPWORDS)))


def phrases(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, significant_words, turn): phrases that tell a text from others, the wordiest first.

    Segments differing in case only count once, as first spelled; boilerplate, and what is
    too short, too long or says too little, doesn't count.
    """
    rows = docs.select(key, F.posexplode(segments(F.col(text))).alias("at", "raw"))
    rows = rows.select(key, "at", F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("text"))
    rows = rows.where(F.length("text").between(SHORTEST_PHRASE, LONGEST_PHRASE) & ~F.lower("text").isin(*K.BOILERPLATE))
    rows = rows.withColumn("significant_words", significant_words(F.col("text"))).where(
        F.col("significant_words") >= LEAST_WORDS
    )
    first = rows.groupBy(key, F.lower("text").alias("_low")).agg(
        F.min(F.struct("at", "text", "significant_words")).alias("f")
    )
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("f.significant_words"), "f.at"))
    return first.select(
        key, F.col("f.text").alias("text"), F.col("f.significant_words").alias("significant_words"), turn.alias("turn")
    )
