"""Language identification by a string kernel with Nystroem landmarks and kernel ridge regression.

The kernel counts the n-grams (1 to 3 characters) that two texts both have, over the root of
the counts that each has. n-grams are told apart by a hash of SLOTS values.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import common

SLOTS = 1 << 16
#: Landmarks of each language, documents of each language to fit on (bounded samples), ridge penalty.
LANDMARKS, FIT_DOCS, RIDGE = 24, 250, 1e-2
#: Landmarks and fitted documents of all languages together, as far as one landmark and LEAST_DOCS of each
#: allow. However many languages there are, each of them is learnt.
MOST_LANDMARKS, MOST_FIT_DOCS, LEAST_DOCS = 256, 4096, 16
#: Characters of a text that are hashed at a time, which bounds memory; all of them are.
CHUNK = 1 << 20


def grams(text: str | None) -> np.ndarray:
    """Sorted slots of the n-grams of a whole text, lower-cased, runs of non-letters as one blank.

    A chunk carries on the last two characters that were kept of the chunks before it, so a
    text has the same n-grams however it is cut.
    """
    if not text:
        return np.zeros(0, np.int64)
    text, held, some = f" {text.lower()} ", np.zeros(SLOTS, bool), False
    carried, after_letter = np.zeros(0, np.uint32), True
    for at in range(0, len(text), CHUNK):
        part = text[at : at + CHUNK]
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters(c, part)
        keep = letter | np.r_[after_letter, letter[:-1]]
        some, after_letter = some or bool(letter.any()), bool(letter[-1])
        c = np.concatenate([carried, np.where(letter, c, 32)[keep].astype(np.uint32)])
        carried = c[-2:]
        one = c * np.uint32(2654435761)
        two = (one[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        three = (two[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for g in (one * np.uint32(2246822519), two, three):
            held[g >> np.uint32(16)] = True
    return np.flatnonzero(held) if some else np.zeros(0, np.int64)


def _letters(c: np.ndarray, part: str) -> np.ndarray:
    """Which characters are letters: a test by table up to U+00FF, by Unicode class beyond."""
    low = _LATIN[np.minimum(c, 255)]
    if (beyond := c > 255).any():
        wide = {x: chr(x).isalpha() for x in np.unique(c[beyond]).tolist()}
        low[beyond] = [wide[x] for x in c[beyond].tolist()]
    return low


_LATIN = np.array([chr(x).isalpha() for x in range(256)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Languages and, for each, what a text's n-grams add to its score (a quarter of a MB a language)."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    sharpness: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A row of each text: the regressions' outputs, as a product of presence and weight matrices."""
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), 64):
            found = [grams(t) for t in texts[at : at + 64]]
            x = np.zeros((len(found), SLOTS), np.float32)
            for i, g in enumerate(found):
                x[i, g] = 1 / np.sqrt(max(1, len(g)))
            out[at : at + 64] = x @ self.weights + self.bias
        return out


def fit(rows: list[tuple[np.ndarray, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model of (slots, language) rows.

    The first row of each language is a landmark, further ones are taken from the languages in
    turn, up to `landmarks` of each and MOST_LANDMARKS of all.
    """
    rows = [r for r in rows if len(r[0])]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    turn, taken = [], dict.fromkeys(languages, 0)
    for i, (_, lang) in enumerate(rows):
        turn.append((taken[lang], i))
        taken[lang] += 1
    picked = [i for nth, i in sorted(turn)[: max(MOST_LANDMARKS, len(languages))] if nth < landmarks]
    norm = np.sqrt([len(g) for g, _ in rows])
    mark = np.zeros((SLOTS, len(picked)), np.float32)
    for k, i in enumerate(picked):
        mark[rows[i][0], k] = 1 / norm[i]
    k_rows = np.array([mark[g].sum(0, dtype=float) for g, _ in rows]) / norm[:, None]
    value, vector = np.linalg.eigh(k_rows[picked])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.column_stack([k_rows @ root, np.ones(len(rows))])
    number = {lang: k for k, lang in enumerate(languages)}
    place = np.array([number[lang] for _, lang in rows])
    y = np.where(place[:, None] == np.arange(len(languages)), 1.0, -1.0)
    w = 1 / np.bincount(place)[place]
    w *= len(rows) / w.sum()
    left = phi.T @ (phi * w[:, None]) + ridge * np.eye(phi.shape[1])
    alpha = np.linalg.solve(left, phi.T @ (y * w[:, None]))
    weights = mark @ (root @ alpha[:-1]).astype(np.float32)
    return Model(languages, weights, alpha[-1], 4.0)


def predicted(docs: DataFrame, model: Model | None, others: tuple[str, ...] = ()) -> DataFrame:
    """docs' (doc_id, *others) with lang_pred and score; `und` and 0 where there is no letter."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            said, sure = np.full(len(texts), "und", object), np.zeros(len(texts))
            told = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
            if told:
                s = model.scores([texts[i] for i in told])
                e = np.exp(model.sharpness * (s - s.max(1, keepdims=True)))
                sure[told] = e.max(1) / e.sum(1)
                said[told] = [model.languages[i] for i in s.argmax(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(said, pa.string()), pa.array(sure)],
                names=[*batch.schema.names[1:], "lang_pred", "score"],
            )

    chosen = docs.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *others
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return common.mapped(chosen, each, f"{schema}, lang_pred string, score double")


def sample(docs: DataFrame, each_language: int = FIT_DOCS) -> list[tuple[np.ndarray, str]]:
    """Slots and language of up to `each_language` different documents a language, by hash of id and text.

    Of all languages together, about MOST_FIT_DOCS, but LEAST_DOCS of each.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(t).astype(np.uint16).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), *batch.columns[1:]], names=["g", "lang", "h"]
            )

    hashed = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"), F.col("text"))
    known = docs.where("text is not null and lang is not null").select("text", "lang", hashed.alias("h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    languages = sizes.agg(F.count("*")).first()[0]
    if not languages:
        return []
    each_language = min(each_language, max(LEAST_DOCS, MOST_FIT_DOCS // languages))
    # what a language's rows must hash below, so that a few more than each_language do; identical rows count once
    steps = 1 << 30
    share = F.least(F.lit(1.0), 1.2 * (each_language + 20) / F.col("n")) * steps
    below = common.stored(sizes.select(F.col("lang").alias("of"), share.cast("long").alias("below")))
    near = known.join(below, (F.col("lang") == F.col("of")) & (F.pmod("h", F.lit(steps)) < F.col("below")))
    picked = near.select("text", "lang", "h").dropDuplicates(["lang", "h"])
    got = common.mapped(picked, slots, "g binary, lang string, h long").collect()
    rows, taken = [], Counter()
    for r in sorted(got, key=lambda r: (r.lang, r.h, r.g)):
        taken[r.lang] += 1
        if taken[r.lang] <= each_language:
            rows.append((np.frombuffer(r.g, np.uint16).astype(np.int64), r.lang))
    return rows


@common.tidy
def language_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of docs.

    Learns from text and lang of the rows that aren't held out (crc32(doc_id as text) mod 5
    is 0), where both are known, all values of lang alike. A text that is null or has no
    letter, or any text if nothing could be learnt, is `und` with score 0; very long texts
    count whole. Rows with equal ids are predicted one by one; an empty table gives no rows;
    other columns of docs aren't read.
    """
    rows = docs.withColumn("held_out", common.fold("doc_id", 5) == 0)
    model = fit(sample(rows.where("not held_out").select("doc_id", "text", "lang")))
    return predicted(rows, model, ("held_out",))
