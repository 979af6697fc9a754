"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of
the perfect binary Golay code (23, 12) with its upper bits zero. Decoding gives a word
the index of its nearest codeword, and the five at distance 4 when the nearest is at
distance 3. Two words at distance 2 or less share one of these indices; of two at
distance 1 or less, one's nearest is among the other's.

Of four differing bits, the two best segments hold at most two, so either both hold at
most one (a key from two segments, one expanded at a time) or one is equal and another
holds at most two (a key from an equal segment and an expanded one). Rows of equal key
meet in a sorted stream of bounded windows and are verified on all 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import common

WORDS_IN_SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Rows of one key that a task compares by itself; the rows of larger keys are dealt out in tiles.
TILE = 16_384
#: Runs up to this length are compared shifted against themselves.
SHORT_RUN = 48
#: Rows of keys that are compared at a time, about.
GATHERED = 32_768
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, which generates the Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: bytes | None) -> int:
    """64 bits, each set if set in over half of the hashes of the text's shingles."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= WORDS_IN_SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - WORDS_IN_SHINGLE + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    hashes = [hashed(joined[s:e], SEED) for s, e in zip(starts, ends[WORDS_IN_SHINGLE - 1 :].tolist(), strict=True)]
    sums = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = np.array(hashes[k : k + 65_536], "<u8")
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(sums * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, key, fp): 16 bytes that tell id and text, and the fingerprint as a signed long.

    A null text counts as empty in the fingerprint, not in the key; a very long one counts whole.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t) for t in common.texts_of(batch.column(2))]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], fps], names=["doc_id", "key", "fp"])

    text = F.col(text_col).cast("string").alias("text")
    key = common.row_key(id_col, text_col).alias("key")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), key, text)
    return common.mapped(chosen, each, "doc_id long, key binary, fp long")


class Golay:
    """Decoding tables of the (23, 12) code: of each syndrome, the leader and its rivals."""

    def __init__(self) -> None:
        unit = [self._rest(1 << k) for k in range(23)]
        self.low = self._table(unit[:12])
        self.high = self._table(unit[12:])
        self.leader = np.zeros(2048, np.int64)
        self.weight = np.zeros(2048, np.int8)
        for weight in (1, 2, 3):
            for picked in itertools.combinations(range(23), weight):
                syndrome = 0
                for k in picked:
                    syndrome ^= unit[k]
                self.leader[syndrome] = sum(1 << k for k in picked)
                self.weight[syndrome] = weight
        rivals: list[list[int]] = [[] for _ in range(2048)]
        for picked in itertools.combinations(range(23), 4):
            syndrome = unit[picked[0]] ^ unit[picked[1]] ^ unit[picked[2]] ^ unit[picked[3]]
            rivals[syndrome].append(sum(1 << k for k in picked))
        self.rivals = np.array([(x + [0] * 5)[:5] for x in rivals], np.int64)

    @staticmethod
    def _rest(word: int) -> int:
        for k in range(22, 10, -1):
            if word >> k & 1:
                word ^= GENERATOR << (k - 11)
        return word

    @staticmethod
    def _table(unit: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for x in unit:
            out = np.concatenate([out, out ^ x])
        return out

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six codeword indices of each word, the nearest first, and which of them hold."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        near = words ^ self.leader[syndrome]
        rivals = words[:, None] ^ self.rivals[syndrome]
        far = self.weight[syndrome] == 3
        return np.column_stack([near, rivals]) >> 11, np.column_stack([np.ones(len(words), bool), *[far] * 5])


def keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """Keys of signed fingerprints and the fingerprints they belong to, without repeats."""
    raw = fps.view(np.uint64)
    words = [((raw >> np.uint64(at)) & np.uint64((1 << wide) - 1)).astype(np.int64) for at, wide in SEGMENTS]
    coded = [golay.indices(w) for w in words]
    out, whose = [], []

    def put(tag: int, key: np.ndarray, held: np.ndarray) -> None:
        out.append((key | tag << 40)[held])
        whose.append(np.broadcast_to(fps[:, None], key.shape)[held])

    for tag, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (a, has_a), (b, has_b) = coded[i], coded[j]
        put(tag, a << 12 | b[:, :1], has_a)
        put(tag, a[:, :1] << 12 | b[:, 1:], has_b[:, 1:])
    for i in range(3):
        b, has_b = coded[(i + 1) % 3]
        put(3 + i, words[i][:, None] << 12 | b, has_b)
    return np.concatenate(out), np.concatenate(whose)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of signed numbers, numpy would count those of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning(fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links of up to `bits` bits connect, fewer than the members."""
    left = np.unique(fps)
    a, b = [], []
    while len(left):
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            x = waiting.pop()
            near = apart(left, x) <= bits
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                waiting.extend(found)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links_of_runs(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal key; key is sorted."""
    bounds = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.r_[0, bounds], np.r_[bounds, len(key)]
    size = ends - starts
    some_a, some_b = [], []
    for s, e in zip(starts[size > SHORT_RUN], ends[size > SHORT_RUN], strict=True):
        a, b = spanning(fp[s:e], bits)
        some_a.append(a)
        some_b.append(b)
    short = np.repeat((size > 1) & (size <= SHORT_RUN), size)
    key, fp = key[short], fp[short]
    for shift in range(1, min(SHORT_RUN, len(key))):
        same = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(same):
            break
        near = same[apart(fp[same + shift], fp[same]) <= bits]
        some_a.append(fp[near])
        some_b.append(fp[near + shift])
    if not some_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(some_a), np.concatenate(some_b)
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two columns of batches, about GATHERED rows at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHERED:
            yield tuple(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))
            held, rows = [], 0
    if rows:
        yield tuple(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1))


def links(distinct: DataFrame, bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Rows (a, b: long) that connect the fingerprints `fp` as all links of up to `bits` bits do.

    `distinct` holds each fingerprint once. bits may be 0 to 4, for which the keys are complete.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the keys are complete for 0 to 4 differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 8192):
                key, fp = keys(fps[at : at + 8192], golay)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["key", "fp"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(over: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), over)), pa.array(a), pa.array(b)], names=["over", "a", "b"]
            )

        none = np.zeros(0, np.int64)
        key, fp, large = none, none, None
        for more_keys, more_fps in _gathered(batches):
            key, fp = np.concatenate([key, more_keys]), np.concatenate([fp, more_fps])
            if large is not None:  # a run that is dealt out whole
                mine = key == large
                if mine.any():
                    yield out(True, key[mine], fp[mine])
                key, fp = key[~mine], fp[~mine]
            if not len(key):
                continue
            large = None
            last = np.searchsorted(key, key[-1])  # the last run may go on
            if last:
                yield from _done(key[:last], fp[:last], out)
            key, fp = key[last:], fp[last:]
            if len(key) > tile:
                large = key[0]
                yield out(True, key, fp)
                key, fp = none, none
        if len(key):
            yield from _done(key, fp, out)

    def _done(key, fp, out):
        bounds = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        size = np.diff(bounds)
        huge = np.repeat(size > tile, size)
        if huge.any():
            yield out(True, key[huge], fp[huge])
            key, fp = key[~huge], fp[~huge]
        if len(key):
            a, b = _links_of_runs(key, fp, bits)
            if len(a):
                yield out(False, a, b)

    key_rows = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    dealt = key_rows.repartition("key").sortWithinPartitions("key", "fp")
    found = common.stored(dealt.mapInArrow(met, "over boolean, a long, b long"))
    edges = found.where("not over").select("a", "b")
    over = found.where("over").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    return edges.union(_tiled(over, bits, tile)) if over.take(1) else edges


def _tiled(over: DataFrame, bits: int, tile: int) -> DataFrame:
    """Links of the members of large keys: each pair of tiles of a key is a group of its own."""
    half = max(1, tile // 2)
    counts = over.groupBy("key").agg(F.ceil(F.count("*") / half).cast("int").alias("tiles"))
    dealt = over.join(counts, "key").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    paired = dealt.select("key", "fp", "t", other.alias("o")).select(
        "key", "fp", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2")
    )

    def span(frame):
        import pandas as pd

        a, b = spanning(frame["fp"].to_numpy(), bits)
        return pd.DataFrame({"a": a, "b": b})

    return paired.groupBy("key", "t1", "t2").applyInPandas(span, "a long, b long")


@common.tidy
def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, tile: int = TILE
) -> DataFrame:
    """Rows (doc_id, fp, component_id, root, key), one for each row of docs.

    component_id is the smallest id reachable by links of up to `bits` differing bits, root
    the component's smallest fingerprint, key 16 bytes that tell id and text. Null and empty
    texts have fingerprint 0 and link like any other. A null id stays null and is no component's id unless the component has
    no other; rows that repeat an id keep a row each. An empty table gives no rows. Other
    columns of docs aren't read.
    """
    return _grouped(common.stored(fingerprints(docs, id_col, text_col)), bits, tile)


def _grouped(marked: DataFrame, bits: int, tile: int) -> DataFrame:
    classes = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = common.components(links(classes, bits, tile))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = common.stored(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = common.stored(rooted.join(named, "root").select("fp", "component_id", "root"))
    return marked.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id", "root", "key")


@common.tidy
def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS, tile: int = TILE
) -> DataFrame:
    """docs with one row of each component: the smallest id's, all columns as they were.

    Of rows that repeat this id, the one with the lowest key of id and text stays, and of rows
    alike in both the one whose columns hash lowest; a component without ids keeps one row.
    Null and empty texts are copies of each other, very long ones count whole; an empty table
    stays empty.
    """
    marked = common.stored(fingerprints(docs, id_col, text_col))
    near = _grouped(marked, bits, tile)
    last = F.lit((1 << 63) - 1)
    kept = near.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last), "key")).alias("k"))
    kept = common.stored(kept.select(F.col("k.key").alias("_key")))
    gone = marked.select(F.col("key").alias("_key")).join(kept, "_key", "left_anti")
    rows = common.packed(docs, common.row_key(id_col, text_col).alias("_key"))
    mine = common.without(rows, common.stored(gone), "_key")
    if marked.join(kept, F.col("key") == F.col("_key"), "left_semi").groupBy("key").count().where("count > 1").take(1):
        mine = mine.groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return mine.select("_row.*")
