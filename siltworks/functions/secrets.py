"""Entropy, placeholders and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions import constants as K

HIDDEN = "…[REDACTED]"


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty or null value."""
    chars = F.filter(F.split(value, ""), lambda c: F.length(c) > 0)
    n = F.length(value)
    one = lambda c: F.length(value) - F.length(F.replace(value, c, F.lit("")))
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - (one(c) / n) * F.log2(one(c) / n))
    return F.when(F.length(value) > 0, bits).otherwise(F.lit(0.0))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"""^['"]|['"]$""", "")


def is_placeholder(value: Column) -> Column:
    plain = unquoted(value)
    return plain.rlike(K.PLACEHOLDER) | plain.rlike(K.PLACEHOLDER_PHRASE)


def is_code_reference(value: Column) -> Column:
    """Two or more names joined by dots, as code refers to a value that is elsewhere."""
    parts = F.split(F.trim(value), r"\.", -1)
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: p.rlike(K.IDENTIFIER))


def is_high_entropy(value: Column, shortest: int = 20, least: float = 3.5) -> Column:
    """Whether a value looks like a random token: long, of token characters, varied, no placeholder, no name."""
    plain = unquoted(value)
    return (
        (F.length(plain) >= shortest) & ~is_placeholder(plain) & ~is_code_reference(plain) & plain.rlike(K.TOKEN_CHARACTERS)
        & ~plain.rlike(r"^(.)\1+$") & (entropy(plain) >= least)
    )


def redacted(value: Column, head: int = 4, tail: int = 4) -> Column:
    """A secret's first and last characters; of a short one the first two only."""
    plain = F.trim(value)
    long = F.concat(
        F.substring(plain, 1, head), F.lit(HIDDEN + "…"), F.substr(plain, F.length(plain) - tail + 1, F.lit(tail))
    )
    short = F.concat(F.substring(plain, 1, 2), F.lit(HIDDEN))
    shown = F.when(F.length(plain) <= head + tail + 3, short).otherwise(long)
    return F.when(F.length(value) > 0, shown).otherwise(F.lit("[REDACTED]"))


def redacted_text(text: Column) -> Column:
    """A text with the secrets in it hidden, shape by shape in a fixed order, each working on what the one before left.

    Of database addresses of one kind, name and password are hidden. All shapes but the last
    are long enough to show a head and a tail; the last, an assignment, shows them of values of
    twelve characters or more and two characters of shorter ones.
    """
    out = text
    for at, (pattern, head, tail) in enumerate(K.REDACTIONS):
        if at == 3:
            out = F.regexp_replace(out, r"""(?i)(mongodb(?:\+srv)?://)[^\s"'<>@]+@""", "$1***:***@")
            out = F.regexp_replace(out, K.PRIVATE_KEY, K.PRIVATE_KEY_HIDDEN)
        out = F.regexp_replace(out, rf"(?=(.{{{head}}}))(?:{pattern})(?<=(.{{{tail}}}))", f"$1{HIDDEN}…$2")
    for pattern, hidden in K.DATABASES:
        out = F.regexp_replace(out, pattern, hidden)
    char = r"""[^\s'"]"""
    short = rf"""(?:['"]{char}{{8,9}}+['"]|['"]{char}{{8,10}}+(?!['"])|{char}{{8,10}}+['"]|{char}{{8,11}}+(?!['"]))(?!{
        char
    })"""
    out = F.regexp_replace(
        out, rf"""{K.ASSIGNED}(?!{short})(?=(.{{4}}))['"]?{char}{{8,}}+['"]?(?<=(.{{4}}))""", f"$1=$2{HIDDEN}…$3"
    )
    return F.regexp_replace(out, rf"{K.ASSIGNED}(?=(.{{2}})){short}", f"$1=$2{HIDDEN}")
