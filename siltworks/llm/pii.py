"""Personal data in texts, disguised or not, as spans of the source text.

The plain patterns are found in the text itself. Then a transducer rewrites disguises
(homoglyphs, invisible characters, spelled digits, at and dot in words or brackets) and
keeps for each character that it writes the source range that it came from; identifiers
found only in what it wrote are mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import common

KINDS = ("email", "ip", "card", "phone")
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match takes whole runs of digits, so none begins within a run
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def plain(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, index of kind, end) of the patterns as they stand in a text, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Letters of other scripts that look like a Latin one, in the order of the Latin ones below them.
_LOOK = "асԁеһіјӏоррԛѕѵԝхуАВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧαιονρ"
_LIKE = "acdehijloppqsvwxyABCEHIJKMOPSTXYABEZHIKMNOPTYXaiovp"
# Words of the digits in the languages covered, top-level names that a spelled-out address may end in.
_DIGITS = {
    "zero": "0", "oh": "0", "null": "0", "cero": "0",
    "one": "1", "eins": "1", "uno": "1",
    "two": "2", "zwei": "2", "deux": "2", "dos": "2",
    "three": "3", "drei": "3", "trois": "3", "tres": "3",
    "four": "4", "vier": "4", "quatre": "4", "cuatro": "4",
    "five": "5", "cinq": "5", "cinco": "5",
    "six": "6", "sechs": "6", "seis": "6",
    "seven": "7", "sieben": "7", "sept": "7", "siete": "7",
    "eight": "8", "acht": "8", "huit": "8", "ocho": "8",
    "nine": "9", "neun": "9", "neuf": "9", "nueve": "9",
}
_TOP = "com|org|net|edu|gov|mil|int|info|biz|name|io|ai|co|me|dev|app|uk|de|fr|es|it|nl|eu|us|ca|at|ch|be|mx|br|jp|cn|ru|in|au"
_INVISIBLE = "­​‌‍⁠﻿"


def _characters() -> dict[int, str | None]:
    """One character for each that only looks otherwise: compatibility forms, digits of other scripts, homoglyphs."""
    kept = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789@.+-_%() ")
    out: dict[int, str | None] = {}
    for code in (*range(0x80, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(code)
        if unicodedata.decimal(c, None) is not None:
            out[code] = str(unicodedata.decimal(c))
        elif (plain_form := unicodedata.normalize("NFKC", c)) in kept:
            out[code] = plain_form
    out |= dict.fromkeys(map(ord, "‐‑‒–—−"), "-")
    out |= {ord("。"): ".", ord("․"): "."}
    out |= {ord(a): b for a, b in zip(_LOOK, _LIKE, strict=True)}
    return out | dict.fromkeys(map(ord, _INVISIBLE))


CHARACTERS = _characters()
_ODD = frozenset(map(chr, CHARACTERS))
_ODD_LATIN = re.compile("[" + "".join(c for c in sorted(_ODD) if c <= "\xff") + "]")
# Patterns below take runs of blanks whole and begin none within a run, so that their time is linear in the text.
_OPEN, _CLOSE = r"(?<!\s)\s*+[\[({<]\s*+", r"\s*+[\])}>]\s*+"
_NAME = "|".join(sorted(_DIGITS, key=len, reverse=True))
_AT, _DOT = "at|arroba|arobase", "dot|punkt|punto|point"
# what may stand between two labels of a spelled-out address, and one that ends in a known name
_BETWEEN = rf"(?:\.|\s++\.\s++|[\s_]++(?:{_DOT})[\s_]++|\s*+[\[({{<]\s*+(?:{_DOT}|\.)\s*+[\])}}>]\s*+)"
_ADDRESS = re.compile(
    rf"[A-Za-z0-9-]++(?:{_BETWEEN}[A-Za-z0-9-]++)*?{_BETWEEN}(?:{_TOP})\b(?:\.(?:{_TOP})\b)?", re.IGNORECASE
)
_BETWEEN_LABELS = re.compile(_BETWEEN, re.IGNORECASE)
# Words that come before "at" and an address of the web, not of a person.
_NOT_NAMES = frozenset(
    "a an and are at available be been by can contact details find found from go hosted in info information is it learn "
    "live located look me more now of on online or order out page people posted read see shop site sold support team that "
    "the them this us visit was we website were with you".split()
)
_DISGUISE = re.compile(
    rf"(?P<at>&#64;|&#x40;|&commat;|{_OPEN}(?:{_AT}){_CLOSE})"
    rf"|(?P<spelled>(?<=[A-Za-z0-9])(?:[\s_]++(?:{_AT})[\s_]++|\s++@\s*+|@\s*+)(?=[A-Za-z0-9]))"
    rf"|(?P<dot>&#46;|&#x2e;|&period;|{_OPEN}(?:{_DOT}|\.){_CLOSE}"
    rf"|(?<=[A-Za-z0-9])[\s_]++(?:{_DOT})[\s_]++(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus[ -]++(?=[0-9]|(?:{_NAME})\b))"
    rf"|(?P<digits>\b(?:{_NAME})(?:[ ,-]++(?:{_NAME}))*\b)",
    re.IGNORECASE,
)
#: What every disguise but an odd character has: one of these words; a mark or a word in one; a blank beside an
#: at sign or around a dot after it; or "at" and an address.
_HINTS = frozenset(w.encode() for w in (*_DOT.split("|"), "plus", *_DIGITS))
_MARKED = re.compile(
    rf"&(?:#64|#x40|commat|#46|#x2e|period);|[\[({{<]\s*+(?:{_AT}|{_DOT}|\.)\s*+[\])}}>]", re.IGNORECASE
)
_AT_SIGN = re.compile(r"\s@|@\s|@[A-Za-z0-9.-]++\s++\.\s")
_AT_NAME = re.compile(
    rf"(?:{_AT})[\s_]++[a-z0-9-]++(?:(?:\.|\s++\.\s++)[a-z0-9-]++)*?(?:\.|\s++\.\s++)(?:{_TOP})\b", re.IGNORECASE
)
_AT_WORDS = frozenset(w.encode() for w in _AT.split("|"))
_ASCII_WORDS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or 48 <= x <= 57 else 32 for x in range(256))
_WORD = re.compile("[A-Za-z]+")
_LAST_WORD = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")


class Written:
    """A rewritten text and, for each of its characters, the source range that it came from."""

    def __init__(self, source: str) -> None:
        self.text, self.start, self.stop = source, range(len(source)), range(1, len(source) + 1)

    def characters(self) -> None:
        """Odd characters become plain ones; invisible ones go, and belong to none."""
        if any(c in self.text for c in _INVISIBLE):
            kept = [i for i, c in enumerate(self.text) if c not in _INVISIBLE]
            self.start, self.stop = [self.start[i] for i in kept], [self.stop[i] for i in kept]
        self.text = self.text.translate(CHARACTERS)

    def words(self) -> None:
        """Spelled digits, at, dot and plus become characters; each stands for its whole source range."""
        text, parts, start, stop, last, at = self.text, [], [], [], 0, 0

        def put(written: str, s: int, e: int) -> None:
            parts.append(written)
            start.append(self.start[s])
            stop.append(self.stop[e - 1])

        def keep(until: int) -> None:
            parts.append(text[last:until])
            start.extend(self.start[last:until])
            stop.extend(self.stop[last:until])

        while m := _DISGUISE.search(text, at):
            s, e = m.span()
            address = _ADDRESS.match(text, e) if m["at"] or m["spelled"] else None
            if m["spelled"] and not (address and self._names(s, m["spelled"])):
                at = e
                continue
            keep(s)
            if m["digits"]:
                for w in _WORD.finditer(m[0]):
                    put(_DIGITS[w[0].lower()], s + w.start(), s + w.end())
            else:
                put("@" if m["at"] or m["spelled"] else "." if m["dot"] else "+", s, e)
            last = at = e
            if address:  # its labels stay, what is between them becomes dots
                for dot in _BETWEEN_LABELS.finditer(text, e, address.end()):
                    keep(dot.start())
                    put(".", *dot.span())
                    last = dot.end()
                keep(address.end())
                last = at = address.end()
        self.text = "".join(parts) + text[last:]
        self.start, self.stop = start + list(self.start[last:]), stop + list(self.stop[last:])

    def _names(self, at: int, spelled: str) -> bool:
        """Whether what comes before a spelled "at" may be a person's name."""
        if "@" in spelled:
            return True
        before = _LAST_WORD.search(self.text, max(0, at - 64), at)
        return bool(before) and before[0].lower() not in _NOT_NAMES


def has_odd(text: str) -> bool:
    """Whether a text has a character that the transducer rewrites."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _ODD.isdisjoint(set(text))
    return bool(_ODD_LATIN.search(text))


def has_hint(text: str) -> bool:
    """Whether a text may have a disguise made of words; without, the transducer would write it as it is."""
    words = frozenset(text.encode("utf-8", "replace").translate(_ASCII_WORDS).split())
    if not _HINTS.isdisjoint(words) or any(c in text for c in "&[({<") and _MARKED.search(text):
        return True
    if "@" in text and _AT_SIGN.search(text):
        return True
    return not _AT_WORDS.isdisjoint(words) and bool(_AT_NAME.search(text))


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans of a whole text, and those added from what the transducer writes.

    A span that it adds has a disguise within and overlaps no plain one of its kind.
    """
    text = text or ""
    base = plain(text)
    odd = has_odd(text)
    if not odd and not has_hint(text):
        return base, []
    w = Written(text)
    if odd:
        w.characters()
    w.words()
    taken = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
    added = []
    for s, kind, e in plain(w.text):
        start, stop = w.start[s], w.stop[e - 1]
        if w.text[s:e] != text[start:stop]:
            # of the plain spans of a kind, which don't overlap, only the last that begins before `stop` may
            before = bisect_left(taken[kind], (stop, 0)) - 1
            if before < 0 or taken[kind][before][1] <= start:
                added.append((start, kind, stop))
    return base, added


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_<kind>, base_sha256, spans, n_added), one for each row of docs.

    n_email to n_phone count the plain spans, n_added those that the transducer adds. Null
    texts count as empty, for which there is no span; very long ones are searched whole, in
    time linear in their length; rows that repeat an id are searched one by one; an empty table
    gives no rows; other columns aren't read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in b) for b, _ in found], pa.int64()) for i in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            whole = pa.array([joined(b + a) for b, a in found], pa.string())
            added = pa.array([len(a) for _, a in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, digests, whole, added],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(
        f"n_{k} long"
        for k in KINDS
    ) + ", base_sha256 string, spans string, n_added long"
    return common.mapped(chosen, each, schema)
