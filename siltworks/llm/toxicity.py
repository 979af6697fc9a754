"""Toxicity by multiple-instance learning: a document is toxic if a sentence of it is.

A sentence's score is a logistic function of the words that it has; a document's is the
noisy-or of its sentences' scores, which is fitted to document labels alone. The sentence
scores then say where a document offends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm import common, quality

#: The most labelled documents to fit on, hash slots of the word counts, words kept for the fit.
FIT_DOCS, SLOTS, VOCABULARY = 8000, 1 << 18, 1024
STEPS, RATE, PENALTY = 300, 0.05, 3e-4
#: Bytes of a word's beginnings that are features; words whose features a task remembers.
STEMS, MEMO = (4, 5, 6), 100_000
#: Ends of sentences become line feeds, other characters that no word has blanks, capitals small.
_TABLE = bytes(
    10 if x in b".!?\n" else x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 or x == 39 else 32
    for x in range(256)
)


def sentences(text: bytes | None) -> list[list[bytes]]:
    """The words of each sentence of a whole text; sentences without words are left out."""
    found = map(bytes.split, (text or b"").translate(_TABLE).split(b"\n"))
    return [x for x in found if x]


def places(text: bytes | None) -> list[tuple[int, int]]:
    """Where in the bytes of a text each of sentences() lies."""
    out, at = [], 0
    for part in (text or b"").translate(_TABLE).split(b"\n"):
        if part.strip():
            out.append((at, at + len(part)))
        at += len(part) + 1
    return out


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, so that unseen endings of a learnt stem count."""
    return [word + b"$", *(word[:k] + b"*" for k in STEMS if len(word) >= k)]


def slot(feature: bytes) -> int:
    return zlib.crc32(feature) & (SLOTS - 1)


@dataclass
class Model:
    """Weights of the features that matter, and the logit of a sentence without any of them."""

    weights: dict[bytes, float]
    bias: float
    known: dict[bytes, tuple[bytes, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.bias = state
        self.known = {}

    def telling(self, word: bytes) -> tuple[bytes, ...]:
        """The features of a word that have a weight; remembered for up to MEMO words."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MEMO:
                self.known.clear()
            found = self.known[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def sentence_scores(self, parts: list[list[bytes]]) -> np.ndarray:
        get, telling, weight = self.known.get, self.telling, self.weights.__getitem__
        sums = np.full(len(parts), self.bias)
        for i, part in enumerate(parts):
            held = set()
            for w in part:
                found = get(w)
                if found is None:
                    found = telling(w)
                if found:
                    held.update(found)
            if held:
                sums[i] += sum(map(weight, held))
        return 1 / (1 + np.exp(-np.clip(sums, -40, 40)))

    def score(self, text: bytes | None) -> float:
        """Noisy-or over the sentences; a text without words has none, so 0."""
        return noisy_or(self.sentence_scores(sentences(text)))

    def judged(self, text: bytes | None, cut: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's score, and start, end (code points) and score of each sentence that scores cut or more."""
        p = self.sentence_scores(sentences(text))
        if not len(p) or p.max() < cut:
            return noisy_or(p), []
        out, seen, chars = [], 0, 0
        for (s, e), one in zip(places(text), p.tolist(), strict=True):
            if one >= cut:
                chars += len(text[seen:s].decode())
                length = len(text[s:e].decode())
                out.append((chars, chars + length, one))
                seen, chars = e, chars + length
        return noisy_or(p), out


def noisy_or(p: np.ndarray) -> float:
    """The chance that any of independent events of chances p happens."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def _word_sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot, the labelled documents that have its words, and the sum of their labels."""

    def make(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((2, SLOTS))
        for text, y in zip(common.texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            at = np.unique([slot(f) for w in {w for s in sentences(text) for w in s} for f in features(w)]).astype(int)
            out[0, at] += 1
            out[1, at] += y
        return out.ravel()

    return tuple(quality._summed(rows, make, 2 * SLOTS).reshape(2, SLOTS))


def _gain(have: np.ndarray, ones: np.ndarray, share: float) -> np.ndarray:
    """How much a feature speaks for toxicity over the documents that have it; 0 if it speaks against it.

    Without toxic words a sentence is clean, so nothing has to be learnt about words of clean documents.
    """
    rate = (ones + 5 * share) / (have + 5)
    told = have * (rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share)))
    return np.where(ones > share * have, told, 0.0)


def fit(rows: DataFrame, steps: int = STEPS) -> Model:
    """A model of rows(text, y), a bounded number of labelled documents.

    Counts of hashed words pick slots, and counts of the words in them the vocabulary; a
    sentence then is the set of those words that it has. Full-batch gradient steps raise the
    likelihood of the labels. With labels of one kind only, every text has that kind.
    """
    rows = common.stored(rows.select(F.col("text").cast("string").alias("text"), F.col("y").cast("double")))
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < toxic < n:
        return Model({}, 40.0 if toxic else -40.0)
    share = toxic / n
    have, ones = _word_sums(rows)
    best = np.argsort(-_gain(have, ones, share), kind="stable")[:VOCABULARY]
    near = np.zeros(SLOTS, bool)
    near[best[_gain(have, ones, share)[best] > 0]] = True

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.binary()))
        for batch in batches:
            texts = common.texts_of(batch.column(0))
            found = [
                [sorted({f for w in s for f in features(w) if near[slot(f)]}) for s in sentences(t)]
                for t in texts
            ]
            yield pa.RecordBatch.from_arrays([pa.array(found, kind), batch.column(1)], names=["bags", "y"])

    bagged = common.stored(common.mapped(rows, bags, "bags array<array<binary>>, y double"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, list[float]] = {}
        for batch in batches:
            for bags_of, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in {w for bag in bags_of for w in bag}:
                    s = sums.setdefault(w, [0, 0.0])
                    s[0] += 1
                    s[1] += y
        n, y = [s[0] for s in sums.values()], [s[1] for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.binary()), pa.array(n, pa.int64()), pa.array(y, pa.float64())], names=["w", "n", "y"]
        )

    parts = bagged.mapInArrow(counted, "w binary, n long, y double")
    found = parts.groupBy("w").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where("n >= 3").collect()
    if not found:
        return Model({}, float(np.log(share / (1 - share))))
    gains = _gain(np.array([r.n for r in found], float), np.array([r.y for r in found]), share)
    words = [bytes(found[k].w) for k in np.argsort(-gains, kind="stable")[:VOCABULARY]]
    index = {w: k for k, w in enumerate(words)}
    word, sentence, doc, y = [], [], [], []
    for r in bagged.toLocalIterator():
        for bag in r.bags:
            mine = [index[w] for w in map(bytes, bag) if w in index]
            word += mine
            sentence += [len(doc)] * len(mine)
            doc.append(len(y))
        y.append(r.y)
    word, sentence, doc, y = np.array(word, int), np.array(sentence, int), np.array(doc, int), np.array(y)
    w, bias = np.zeros(len(words)), -4.0
    first, second = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, w[word], len(doc)) + bias, -40, 40)))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))
        q = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
        slope = ((q - y) / q)[doc] * p  # of the negated likelihood, for a sentence's logit
        grad = np.r_[
            np.bincount(word, slope[sentence], len(words)) / len(y) + PENALTY * np.sign(w), slope.sum() / len(y)
        ]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({x: float(v) for x, v in zip(words, w, strict=True) if abs(v) > 0.2}, float(bias))


def scored(docs: DataFrame, model: Model, others: tuple[str, ...] = (), spans: bool = False) -> DataFrame:
    """docs' (doc_id, *others) with score and, if asked for, the offending sentences."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        names = ("start", "stop", "score")
        for batch in batches:
            texts = common.texts_of(batch.column(0))
            if spans:
                found = [model.judged(t) for t in texts]
                told = [[dict(zip(names, x, strict=True)) for x in places] for _, places in found]
                more = [pa.array([score for score, _ in found], pa.float64()), pa.array(told, kind)]
            else:
                more = [pa.array([model.score(t) for t in texts], pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *more], names=[*batch.schema.names[1:], "score", *["spans"] * spans]
            )

    chosen = docs.select(
        F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *others
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    tail = ", spans array<struct<start:int,stop:int,score:double>>" * spans
    return common.mapped(chosen, each, f"{schema}, score double{tail}")


def learnt(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, at_most: int = FIT_DOCS) -> Model:
    """The model of labels.toxic on documents that aren't held out (crc32 of id mod 4 is 2 by default).

    About at_most labelled documents count, chosen by hash of id, so their ids can be sent to
    every task. Where ids repeat, about at_most of their rows do, by hash of id and text, and
    rows alike in both count once.
    """
    out = common.fold("doc_id", 4) == 2 if held_out is None else held_out
    known = quality.labelled(labels, "toxic").where(~out)
    n = known.count()
    if n > at_most:
        known = known.where(_hashed_below(F.xxhash64("doc_id", F.lit("toxicity")), at_most / n))
    known = F.broadcast(common.stored(known))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")
    rows = mine.count()
    h = F.xxhash64("doc_id", F.lit("row"), "text").alias("h")
    if rows > 1.1 * at_most:
        mine = mine.where(_hashed_below(h, at_most / rows))
    return fit(mine.select("text", "y", h).dropDuplicates(["h"]))


def _hashed_below(h: Column, share: float) -> Column:
    """A condition that a share of the values of h meets."""
    return F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * share)


@common.tidy
def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3, spans: bool = False) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs, and spans if asked for.

    Learns labels.toxic from the rows that aren't held out (crc32(doc_id as text) mod 4 is 2)
    and reads nothing but texts for a score. Null and empty texts score 0, very long ones
    count whole; rows that repeat an id are scored one by one; without labels each score is
    next to 0. An empty table gives no rows. Other columns of docs aren't read.
    """
    model = learnt(docs, labels)
    rows = docs.withColumn("held_out", common.fold("doc_id", 4) == 2)
    found = scored(rows, model, ("held_out",), spans)
    return found.withColumn("predicted", (F.col("score") >= cut).cast("int"))


@common.tidy
def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """docs' rows that score below cut, with the columns they had.

    So null and empty texts stay, and very long ones are judged whole. Repeated rows go or stay
    together; an empty table stays empty.
    """
    model = learnt(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts_of(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([model.score(t) < cut for t in texts], pa.bool_()))

    return common.mapped(docs, clean, docs.schema)
