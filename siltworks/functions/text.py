"""Term, alias and token matching as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

SNIPPET, FUZZY, LENGTHS_APART, SHORTEST_TOKEN = 40, 0.85, 2, 3


def lines(text: Column) -> Column:
    """Array of lines, split at line feeds with or without a carriage return; trailing empties stay."""
    return F.split(text, "\r?\n", -1)


def blob(*parts: Column) -> Column:
    """One lower-cased text of parts and arrays of parts; nulls are left out."""
    return F.lower(F.concat_ws(" ", *parts))


def terms_in(text: Column, terms: tuple[str, ...]) -> Column:
    """The terms, in their order, that a lower-cased text contains anywhere."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a text contains any of the terms."""
    out = F.contains(text, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(text, F.lit(t))
    return out


def quoted(term: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)


def has_term(text: Column, term: str | Column) -> Column:
    """Whether a lower-cased text has the term between characters that are no letter or digit."""
    if isinstance(term, str):
        return text.rlike(f"(?:^|[^a-z0-9]){quoted(term.lower())}(?:$|[^a-z0-9])")
    safe = F.regexp_replace(F.lower(term), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("(?:^|[^a-z0-9])"), safe, F.lit("(?:$|[^a-z0-9])"))
    # a pattern from a column is compiled for each value, so only where the bare term is there
    return F.when(F.contains(text, F.lower(term)), F.regexp(text, pattern)).when(text.isNotNull(), F.lit(False))


def whole_terms_in(text: Column, terms: tuple[str, ...]) -> Column:
    found = [F.when(has_term(text, t), F.lit(t)) for t in terms]
    return F.array_compact(F.array(*found))


def word_pattern(term: Column) -> Column:
    """A pattern of the term as a word or as a part of a camel-case name."""
    safe = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:"), safe, F.lit(")(?![a-z0-9])"))


def word_index(text: Column, term: Column) -> Column:
    """Where (from 0) the term first stands as a word of the text, -1 if nowhere or if the term is empty.

    The pattern, compiled for each value, is tried only on texts that have the bare term.
    """
    at = F.regexp_instr(text, word_pattern(term)) - 1
    there = (F.length(term) > 0) & F.contains(F.lower(text), F.lower(term))
    return F.when(there, F.coalesce(at, F.lit(-1))).otherwise(F.lit(-1))


def first_alias(text: Column, aliases: Column) -> Column:
    """The first alias, in list order, that is a word of the text, as struct (alias, at); null if none is."""
    hits = F.transform(aliases, lambda a: F.struct(a.alias("alias"), word_index(text, F.lower(a)).alias("at")))
    return F.get(F.filter(hits, lambda h: h["at"] >= 0), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of three characters or more."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= SHORTEST_TOKEN)


#: What JavaScript's trim() takes away.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def snippet(text: Column, at: Column, length: Column) -> Column:
    """What surrounds a hit, with an ellipsis where something is cut off."""
    start = F.greatest(F.lit(0), at - SNIPPET)
    stop = F.least(F.length(text), at + length + SNIPPET)
    cut = F.regexp_replace(F.substr(text, start + 1, stop - start), f"^{SPACE}+|{SPACE}+$", "")
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(stop < F.length(text), "…").otherwise(""))


def similarity(a: str, b: str) -> float:
    """Jaro-Winkler with half transpositions kept, the prefix always counted, and no match for two single characters."""
    if not a or not b:
        return float(a == b)
    reach = max(len(a), len(b)) // 2 - 1
    free = list(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if free[j] == c:
                free[j] = None
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if f is None]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """similarity() of each pair; equal pairs of a batch are compared once."""
    known: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else similarity(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def most_alike(a: Column, b: Column) -> Column:
    """A bound on similarity(a, b) from above: as if all characters that both have matched in their order.

    Of m matches without swaps Jaro's value is (m / |a| + m / |b| + 1) / 3, which grows with m,
    and m is at most the number of characters that both have, with repeats; the prefix is that
    of the texts. So a pair whose bound is below a threshold can be left out unseen.
    """
    count = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    chars = F.filter(F.array_distinct(F.split(a, "")), lambda c: F.length(c) > 0)
    m = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))
    jaro = F.when(m > 0, (m / F.length(a) + m / F.length(b) + 1) / 3).otherwise(F.lit(0.0))
    prefix = F.lit(0)
    for k in range(4, 0, -1):
        alike = (F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k))
        prefix = F.when(alike & (prefix == 0), k).otherwise(prefix)
    return jaro + prefix * 0.1 * (1 - jaro)


def resembling(pairs: DataFrame, a: str, b: str, least: float = FUZZY) -> DataFrame:
    """pairs with `similarity`, those of `least` or more: what the bound leaves is compared in Python."""
    near = pairs.where(most_alike(F.col(a), F.col(b)) >= least - 1e-9)
    return near.withColumn("similarity", jaro_winkler(a, b)).where(F.col("similarity") >= least)


def fuzzy_pairs(words: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (token, alias, similarity) of words(token) and aliases(alias) that resemble each other.

    Distinct words meet only aliases of a length at most two apart, by an equi-join on the
    length, and of these only pairs that share enough characters are compared.
    """
    near = F.explode(F.sequence(F.length("alias") - LENGTHS_APART, F.length("alias") + LENGTHS_APART))
    by_length = aliases.select("alias").distinct().select("alias", near.alias("_n"))
    pairs = words.select("token").distinct().withColumn("_n", F.length("token")).join(by_length, "_n").drop("_n")
    return resembling(pairs, "token", "alias")


def first_spellings(rows: DataFrame, keyword: str, order: str) -> DataFrame:
    """rows with trimmed keywords, the first of each that differ in case only; blank ones go."""
    trimmed = rows.withColumn(keyword, F.trim(keyword)).where(F.length(keyword) > 0)
    turn = F.row_number().over(Window.partitionBy(F.lower(keyword)).orderBy(order))
    return trimmed.withColumn("_turn", turn).where("_turn = 1").drop("_turn")
