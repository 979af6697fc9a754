"""Benchmark decontamination by a positional inverted index over the training tokens.

The index is split by document: a segment holds every token of some consecutive documents
as postings, for each term the sorted positions at which it stands. Documents of a segment
are laid out on one axis with a gap between them, so no phrase crosses a border. A segment
is one row of a stored table and answers any query by itself; nothing is gathered by term.

Test windows are filed under their rarest word. A segment looks up its own terms there, so
only windows whose rarest word it holds are looked at, and only those with all words searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import common

WINDOW = 10
#: A window matches by proximity if its words stand, in any order, within SLACK times as many words as it has.
SLACK = 2
#: Tokens at which a segment ends; a longer document is a segment of its own.
SEGMENT = 1 << 18
#: Bytes of test texts that are sent to every task at once; more are searched in as many passes as needed.
BLOCK_BYTES = 8 << 20
#: Windows that are looked up in a segment at a time.
LOOKED_UP = 1 << 16
#: Capitals become small, other characters that no word has become blanks.
_TABLE = bytes(
    x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256)
)
INDEX = "segment long, row_ids array<{}>, lengths array<int>, terms binary, counts binary, gaps binary"


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, small letters and characters beyond ASCII, after lower-casing A-Z."""
    return (text or b"").translate(_TABLE).split()


def _segment(number: int, ids: list, found: list[list[bytes]], kind: pa.DataType) -> pa.RecordBatch:
    lengths = np.array([len(f) for f in found], np.int64)
    codes = pa.array([w for f in found for w in f], pa.binary()).dictionary_encode()
    code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(len(code)) + np.repeat(np.arange(len(found)), lengths)
    order = np.argsort(code, kind="stable")
    terms = codes.dictionary.to_pylist()
    counts = np.bincount(code, minlength=len(terms)).astype(np.int32)
    place = at[order]
    gaps = np.diff(place, prepend=0)
    starts = (np.cumsum(counts) - counts).astype(np.int64)
    gaps[starts] = place[starts]
    columns = [
        pa.array([number], pa.int64()),
        pa.array([ids], pa.list_(kind)),
        pa.array([lengths.tolist()], pa.list_(pa.int32())),
        pa.array([b" ".join(terms)], pa.binary()),
        pa.array([counts.tobytes()], pa.binary()),
        pa.array([gaps.astype(np.int32).tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["segment", "row_ids", "lengths", "terms", "counts", "gaps"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """A stored table of segments, INDEX, with the postings of all tokens of all rows of docs.

    Ids are numbers or, where id_col is binary, keys. Null texts have no tokens but are rows.
    """
    keys = docs.schema[id_col].dataType.simpleString() == "binary"
    kind, name = (pa.binary(), "binary") if keys else (pa.int64(), "bigint")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, found, n = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts_of(batch.column(1)), strict=True):
                mine = words(text)
                if ids and n + len(mine) > segment:
                    yield _segment(number, ids, found, kind)
                    number, ids, found, n = number + 1, [], [], 0
                ids.append(doc_id)
                found.append(mine)
                n += len(mine)
        if ids:
            yield _segment(number, ids, found, kind)

    chosen = docs.select(F.col(id_col).cast(name).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.stored(common.mapped(chosen, each, INDEX.format(name)))


class Segment:
    """A segment's postings, opened."""

    def __init__(self, lengths: list[int], terms: bytes, counts: bytes, gaps: bytes) -> None:
        self.terms = terms.split(b" ") if terms else []
        self.counts = np.frombuffer(counts, np.int32)
        self.ends = np.cumsum(self.counts, dtype=np.int64)
        self.gaps = np.frombuffer(gaps, np.int32)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.opened: dict[int, np.ndarray] = {}

    def positions(self, code: int) -> np.ndarray:
        """Sorted positions of a term on the segment's axis."""
        if code not in self.opened:
            end = self.ends[code]
            self.opened[code] = np.cumsum(self.gaps[end - self.counts[code] : end], dtype=np.int64)
        return self.opened[code]

    def matches(self, codes: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the phrase of these terms begins, and the documents that have all of them within `span` words.

        From the rarest term on, positions stay that have each other term less than `span`
        words away; these are then tested for the phrase, by offset, and for the span.
        """
        order = sorted(dict.fromkeys(codes), key=lambda c: self.counts[c])
        at = self.positions(order[0])
        for code in order[1:]:
            mine = self.positions(code)
            spot = np.searchsorted(mine, at)
            before, after = mine[np.maximum(spot - 1, 0)], mine[np.minimum(spot, len(mine) - 1)]
            at = at[(np.abs(before - at) < span) | (np.abs(after - at) < span)]
            if not len(at):
                return at, at
        starts = at - codes.index(order[0])
        for k, code in enumerate(codes):
            mine = self.positions(code)
            spot = np.minimum(np.searchsorted(mine, starts + k), len(mine) - 1)
            starts = starts[mine[spot] == starts + k]
        return starts, np.unique(self.doc_of(at[self._within(order, at, span)]))

    def _within(self, codes: list[int], at: np.ndarray, span: int) -> np.ndarray:
        """Of each position, whether `span` words of its document that it is among hold all the terms."""
        doc = self.doc_of(at)
        first = np.maximum(at[:, None] - np.arange(span), self.starts[doc][:, None])
        last = np.minimum(first + span, (self.starts + self.lengths)[doc][:, None])
        held = np.ones(first.shape, bool)
        for code in codes:
            mine = self.positions(code)
            spot = np.searchsorted(mine, first)
            held &= (spot < len(mine)) & (mine[np.minimum(spot, len(mine) - 1)] < last)
        return held.any(1)

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


class Asked:
    """The windows of a bounded list of (item_id, text): all runs of `window` words of an item, or the whole
    of a shorter one with any words. Words are sent once, windows as ranges of numbers."""

    def __init__(self, items: list[tuple[int, bytes]], window: int) -> None:
        found = [words(text) for _, text in items]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = pa.array([w for f in found for w in f], pa.binary()).dictionary_encode()
        self.words = b" ".join(flat.dictionary.to_pylist())
        self.codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.ids = np.array([item for item, _ in items], np.int64)
        many = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
        self.item = np.repeat(np.arange(len(items)), many).astype(np.int32)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.start = (np.repeat(np.cumsum(sizes) - sizes, many) + nth).astype(np.int64)
        self.size = np.minimum(sizes, window)[self.item].astype(np.int32)
        self.width = window
        # the rarest word of each window among the test texts, and the windows in order of it
        count = np.bincount(self.codes, minlength=1)
        rarest = np.zeros(len(self.start), np.int32)
        for at in range(0, len(rarest), LOOKED_UP):
            mine = self.of(np.arange(at, min(at + LOOKED_UP, len(rarest))))
            rarest[at : at + len(mine)] = mine[np.arange(len(mine)), count[mine].argmin(1)]
        self.order = np.argsort(rarest, kind="stable").astype(np.int32)
        self.ends = np.cumsum(np.bincount(rarest, minlength=len(flat.dictionary)))
        self._number: dict[bytes, int] | None = None

    def of(self, windows: np.ndarray) -> np.ndarray:
        """The words of windows, a row each; the last word of a short one is repeated."""
        step = np.minimum(np.arange(self.width), self.size[windows][:, None] - 1)
        return self.codes[self.start[windows][:, None] + step]

    def held_by(self, terms: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """The windows all of whose words are terms, each with the terms' numbers in its order."""
        if self._number is None:
            self._number = {w: i for i, w in enumerate(self.words.split(b" "))} if self.words else {}
        here = np.full(max(1, len(self._number)), -1, np.int32)
        number = self._number.get
        for i, term in enumerate(terms):
            k = number(term)
            if k is not None:
                here[k] = i
        known = np.flatnonzero(here >= 0)
        if not len(known) or not len(self.start):
            return
        ends = self.ends[known]
        many = ends - np.where(known > 0, self.ends[known - 1], 0)
        places = np.repeat(ends - np.cumsum(many), many) + np.arange(many.sum())
        windows = np.sort(self.order[places])
        for at in range(0, len(windows), LOOKED_UP):
            part = windows[at : at + LOOKED_UP]
            mine = here[self.of(part)]
            for k in np.flatnonzero((mine >= 0).all(1)).tolist():
                w = part[k]
                yield int(w), mine[k, : self.size[w]].tolist()


HITS = (
    "doc_id {}, segment long, row int, n_words long, spans array<struct<start:long,stop:long>>, "
    "items array<long>, near array<long>"
)


def search(index: DataFrame, items: list[tuple[int, bytes]], window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """HITS of a bounded list of (item_id, text).

    Of each indexed row, the word ranges that occurrences of windows cover, merged; the items
    with an occurrence; and in `near` those with a window whose words all stand, in any order,
    within `slack` times as many words of the row as it has (so those of `items` as well).
    """
    sent = index.sparkSession.sparkContext.broadcast(Asked(items, window))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _hits(batch.slice(k, 1), sent.value, slack)

    kind = index.schema["row_ids"].dataType.elementType.simpleString()
    return index.mapInArrow(each, HITS.format(kind))


def _hits(batch: pa.RecordBatch, asked: Asked, slack: int) -> pa.RecordBatch:
    row = batch.to_pylist()[0]
    seg = Segment(row["lengths"], row["terms"], row["counts"], row["gaps"])
    n = len(seg.lengths)
    covers: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[int]] = [set() for _ in range(n)]
    near: list[set[int]] = [set() for _ in range(n)]
    for window, codes in asked.held_by(seg.terms):
        at, close = seg.matches(codes, slack * len(codes))
        item = int(asked.ids[asked.item[window]])
        for d in close.tolist():
            near[d].add(item)
        for d, p in zip(seg.doc_of(at).tolist(), at.tolist(), strict=True):
            start = p - int(seg.starts[d])
            covers[d].append((start, start + len(codes)))
            items[d].add(item)
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    arrays = [
        pa.array(row["row_ids"], batch.schema.field("row_ids").type.value_type),
        pa.array([row["segment"]] * n, pa.int64()),
        pa.array(range(n), pa.int32()),
        pa.array(seg.lengths),
        pa.array([[{"start": s, "stop": e} for s, e in merged(c)] for c in covers], pa.list_(span)),
        pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
        pa.array([sorted(x) for x in near], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "segment", "row", "n_words", "spans", "items", "near"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


@common.tidy
def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    segment: int = SEGMENT,
    block_bytes: int = BLOCK_BYTES,
    slack: int = SLACK,
) -> DataFrame:
    """HITS of all of benchmark's items, one row for each row of docs, with n_hit.

    Null and empty texts have no words; very long ones are searched whole; rows that repeat an
    id are searched one by one. Items without an id aren't searched; items that repeat an id
    count once. Without items nothing is hit; an empty table gives no rows. The items are
    searched in blocks of block_bytes of text, each against the whole index; what several
    blocks find in a row is put together. Other columns aren't read.
    """
    index = build_index(docs, segment=segment)
    asked = benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")
    )
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    found = []
    for b in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found.append(search(index, [(r.item_id, bytes(r.text)) for r in mine.distinct().collect()], window, slack))
    hits = found[0]
    if blocks > 1:
        for f in found[1:]:
            hits = hits.union(f)

        def both(name: str):
            return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)

        one = hits.groupBy("segment", "row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            both("items"),
            both("near"),
        )
        hits = one.withColumn("spans", _merged_column())
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return hits.withColumn("n_hit", n_hit)


def _merged_column():
    """The sorted column spans with overlaps merged."""
    return F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (o, s) -> "
        "if(size(o) > 0 and s.start <= try_element_at(o, -1).stop, "
        "concat(slice(o, 1, greatest(size(o) - 1, 0)), array(named_struct('start', try_element_at(o, -1).start, "
        "'stop', greatest(try_element_at(o, -1).stop, s.stop)))), concat(o, array(s))))"
    )


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns of contaminated(), and n_near, the items that match by proximity."""
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


@common.tidy
def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs' rows that no item's window occurs in, with the columns they had.

    Rows are told apart by 16 bytes of id and text, in which nulls count, so repeated or missing
    ids do no harm. Null and empty texts stay, very long ones are searched whole; rows alike in
    id and text go or stay together; an empty table stays empty.
    """
    key = common.row_key("doc_id", "text")
    found = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, **options)
    bad = common.stored(found.where("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct())
    kept = common.packed(docs, key.alias("_key")).join(bad, F.col("_key") == F.col("_bad"), "left_anti")
    return kept.select("_row.*")
