"""Content hashes, winnowed fingerprints and keys."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

GRAM, WINDOW = 25, 4
SEPARATOR = "\u0001"
_TOKEN = re.compile(
    r"[A-Za-z0-9_]+|[^\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeffA-Za-z0-9_]"
)


def normalised(text: Column) -> Column:
    """Text with line feeds only and without blanks at the ends of lines."""
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t]+(?=\n|\z)", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def code_tokens(text: str) -> list[str]:
    """Names and numbers as wholes, other visible characters one by one."""
    return _TOKEN.findall(text)


def gram_hashes(words: list[str], gram: int = GRAM) -> np.ndarray:
    """The first 64 bits of the SHA-256 of each run of `gram` tokens; of a shorter text its one hash; of none nothing.

    Runs are slices of the joined tokens, between the tokens' offsets.
    """
    if not words:
        return np.zeros(0, np.uint64)
    parts = [w.encode("utf-8", "surrogatepass") for w in words]
    joined = SEPARATOR.encode().join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(parts) > gram:
        starts, ends = starts[: len(parts) - gram + 1], ends[gram - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = hashlib.sha256
    first = b"".join([hashed(joined[s:e]).digest()[:8] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(first, ">u8").astype(np.uint64)


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The least hash of each window, without repeats, in order; all hashes where there is no full window."""
    if len(hashes) > window:
        least = hashes[: len(hashes) - window + 1]
        for k in range(1, window):
            least = np.minimum(least, hashes[k : len(hashes) - window + 1 + k])
        hashes = least
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


@F.pandas_udf(ArrayType(StringType()))
def fingerprints(text: pd.Series) -> pd.Series:
    """The winnowed fingerprints of each text, as 16 hexadecimal digits each, in one pass; null for null."""

    def one(t: str | None) -> list[str] | None:
        return None if t is None else [f"{h:016x}" for h in winnowed(gram_hashes(code_tokens(t))).tolist()]

    return text.map(one)


#: As if it weren't deterministic, so that the optimizer copies it into no filter and a text is read once.
fingerprints = fingerprints.asNondeterministic()


def finding_key(identity: Column, rule_ids: Column, branch: Column | None = None) -> Column:
    """A finding's fingerprint, from an id, perhaps a branch, and its sorted rule ids with repeats."""
    rules = F.array_join(F.array_sort(rule_ids), ",")
    parts = [identity.cast("string"), *([branch] if branch is not None else []), rules]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)


def ruleset_version(version: Column, rule_ids: Column) -> Column:
    return F.substring(F.sha2(F.concat(version, F.lit(":"), F.array_join(F.array_sort(rule_ids), ",")), 256), 1, 16)


def config_hash(config: Column) -> Column:
    """Hash of a struct's JSON, whose field order is that of the struct."""
    return F.substring(F.sha2(F.to_json(config), 256), 1, 24)


def context_hash(context: Column, prompt_version: str) -> Column:
    """Hash of a context and of the prompt version; a struct with sorted names makes it stable."""
    return F.sha2(F.concat(F.to_json(context), F.lit(prompt_version)), 256)


def query_hash(kind: Column, query: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit(":"), query), 256)


def synthetic_index(base: int, query: Column, span: int = 800_000) -> Column:
    """base plus a polynomial hash of the query's characters, modulo span."""
    codes = F.transform(F.filter(F.split(query, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4_294_967_296)
    return F.lit(base) + h % span


def known_value(value: Column) -> Column:
    """The hash by which a known secret is kept and found again."""
    return F.sha2(value, 256)
