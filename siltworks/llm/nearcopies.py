"""Near copies by the Jaccard similarity of word shingles: MinHash bands, verified exactly.

Of two texts with similarity 0.8, one of BANDS bands of ROWS minima agrees but for
(1 - 0.8 ** 5) ** 32 = 3e-6 of the pairs; what a band joins is compared on all shingles.
In each bucket the smallest id is compared with all others first, which takes groups of
copies apart; what is left of the buckets is compared within tasks, so that no pairs but
links leave them. Before shingles are compared, their number and 128 bits of the minima
must allow it (with similarity 0.8 over 32 bits differ in 2e-7 of the pairs).

Rows are numbered in the order of their ids, and what the bands deal out is a number and a
band; sizes, bits and shingles are fetched for those that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import common, simhash

WORDS_IN_SHINGLE = 5
#: Similarity in fifths, so that no rounding decides.
FIFTHS = 4
BANDS = 32
ROWS = 5
BITS = 128
MAX_BITS = 32
SEED = 42
#: Rows of a bucket that a task pairs by itself; larger buckets are dealt out in tiles.
TILE = 1_024
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
LAST = (1 << 63) - 1


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words, or of the whole of a shorter text with any."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = WORDS_IN_SHINGLE
    runs = (b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(len(FACTORS), np.uint64((1 << 64) - 1))
    for k in range(0, len(hashes), 512):
        out = np.minimum(out, (hashes[k : k + 512, None] * FACTORS).min(0))
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether a fraction of 0.8 or more of the shingles of either is in both."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= FIFTHS * (len(a) + len(b) - both)


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys, ids, sizes, low, high, bands = [], [], [], [], [], []
    rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts_of(batch.column(2))
    for key, doc_id, text in zip(*rows, strict=True):
        found = shingles(text)
        if not len(found):
            continue
        least = minima(found)
        bits = np.packbits((least[:BITS] >> np.uint64(32) & np.uint64(1)).astype(np.uint8)).view(np.int64)
        keys.append(key)
        ids.append(doc_id)
        sizes.append(len(found))
        low.append(int(bits[0]))
        high.append(int(bits[1]))
        runs = (least[k * ROWS : (k + 1) * ROWS].tobytes() for k in range(BANDS))
        bands.append([xxhash.xxh64_intdigest(run, k) - (1 << 63) for k, run in enumerate(runs)])
    arrays = [pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in (ids, sizes, low, high))]
    arrays.append(pa.array(bands, pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "n", "low", "high", "bands"])


def _linked(frame):
    """Links that connect what all similar pairs of a bucket connect, fewer than its rows."""
    import pandas as pd

    key, n, low, high = (frame[c].to_numpy() for c in ("node", "n", "low", "high"))
    sets = [np.frombuffer(s, np.uint64) for s in frame["s"]]
    left, a, b = np.arange(len(key)), [], []
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            x = waiting.pop()
            differ = simhash.apart(low[left], low[x]).astype(int) + simhash.apart(high[left], high[x])
            fits = (differ <= MAX_BITS) & (5 * np.minimum(n[left], n[x]) >= FIFTHS * np.maximum(n[left], n[x]))
            near = np.zeros(len(left), bool)
            near[fits] = [similar(sets[x], sets[y]) for y in left[fits]]
            found, left = left[near], left[~near]
            a += [key[x]] * len(found)
            b += key[found].tolist()
            waiting += found.tolist()
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def _sets(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (node, s) of the rows asked(node, key): their texts' shingles; texts has rows (key, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).tobytes() for t in common.texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "s"])

    # stored first, so that the planner knows whether it is small enough to go where the texts are
    asked = common.stored(asked)
    _, may = common.sieve(texts, asked, "key")
    mine = may.join(asked, "key").select("node", "text").dropDuplicates(["node"])
    return common.stored(common.mapped(mine, hashed, "node long, s binary"))


def _verified(pairs: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of numbers whose texts are similar; known has rows (node, key, n, low, high)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            near = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    for side in ("a", "b"):
        mine = (F.col(c).alias(c + side) for c in ("n", "low", "high"))
        pairs = pairs.join(known.select(F.col("node").alias(side), *mine), side)
    low, high = F.col("lowa").bitwiseXOR(F.col("lowb")), F.col("higha").bitwiseXOR(F.col("highb"))
    differ = F.bit_count(low) + F.bit_count(high)
    fits = (differ <= MAX_BITS) & (5 * F.least("na", "nb") >= FIFTHS * F.greatest("na", "nb"))
    pairs = common.stored(pairs.where(fits).select("a", "b"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(asked.join(known.select("node", "key"), "node"), texts)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    return common.stored(common.mapped(both, compared, "a long, b long"))


@common.tidy
def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """docs without all but one of each group that similar texts link: the smallest id's row stays.

    Of a group's rows with the same id the one with the lowest key of id and text stays. Texts
    that are null or without words stay, very long ones count whole; rows alike in id and text
    go or stay together; an empty table stays empty.
    """
    key, text = common.row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text")
    whole, texts = common.packed(docs, key), docs.select(key, text)
    rows = docs.select(key, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), text)
    schema = "key binary, doc_id long, n long, low long, high long, bands array<long>"
    signed = common.mapped(rows, lambda batches: map(_signed, batches), schema).dropDuplicates(["key"])
    # numbers given as a sorted table is written are in its order
    signed = common.stored(signed.orderBy("doc_id", "key").withColumn("node", F.monotonically_increasing_id()))
    known = signed.select("node", "key", "n", "low", "high")

    dealt = signed.select("node", F.explode("bands").alias("band"))
    first = dealt.groupBy("band").agg(F.min("node").alias("c"), F.count("*").alias("members")).where("members > 1")
    met = common.stored(dealt.join(first.select("band", "c"), "band").where("node <> c"))
    near = _verified(met.select(F.col("c").alias("a"), F.col("node").alias("b")).distinct(), known, texts)
    gone = common.stored(near.select(F.col("b").alias("node")).distinct())

    left = met.select("band", "node").join(gone, "node", "left_anti")
    half = max(1, tile // 2)
    tiles = left.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    tiles = tiles.select("band", F.ceil(F.col("m") / half).cast("int").alias("tiles"))
    left = common.stored(left.join(tiles, "band").join(known, "node"))
    dealt = left.withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2")
    dealt = dealt.select("band", "node", "n", "low", "high", *pair)
    dealt = dealt.join(_sets(left.select("node", "key").distinct(), texts), "node")
    more = common.stored(dealt.groupBy("band", "t1", "t2").applyInPandas(_linked, "a long, b long"))
    # of a component the smallest number stays, which is the smallest id's
    linked = common.components(more).where("node <> root").select("node")
    keys = common.stored(gone.union(linked).distinct().join(known.select("node", "key"), "node").select("key"))
    return common.without(whole, keys, "key").select("_row.*")
