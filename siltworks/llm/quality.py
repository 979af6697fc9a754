"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.llm import common

#: Random Fourier features; width of the Gaussian kernel in standard deviations; ridge penalty.
FEATURES, WIDTH, RIDGE, SEED, FOLDS = 192, 4.0, 1.0, 7, 4
#: The least number of tasks that a sum may take, and the groups in which the tasks' sums are added.
PARTS, GROUPS = 128, (64, 8)
#: Score bins of the calibration, which bound what the driver gets.
BINS = 2000
STATISTICS = (
    "words word_chars word_spread long_words distinct_words top_word repeated_next upper digits spaces marks "
    "pipes symbols sentences line_chars lines distinct_lines words_with_marks non_ascii mean_run"
).split()
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS of a whole text; null counts as empty, for which they are zero."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    lens = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = seen[_LETTERS].sum()
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    symbols = int(seen[33:127].sum() - seen[48:58].sum() - seen[65:91].sum() - seen[97:123].sum())
    ends = int(seen[46] + seen[33] + seen[63])
    common_marks = int(seen[46] + seen[44])
    return [
        np.log1p(n), lens.mean(), lens.std(), (lens > 12).mean(), len(counts) / n, max(counts.values()) / n,
        repeated / n, seen[65:91].sum() / size, seen[48:58].sum() / size, seen[[9, 10, 13, 32]].sum() / size,
        common_marks / n, seen[124] / n, (symbols - common_marks) / n, ends / n, np.log1p(size / len(lines)),
        np.log1p(len(lines)), len(set(lines)) / len(lines), 1 - letters / max(1, size - seen[[9, 10, 13, 32]].sum()),
        seen[128:].sum() / size, n / (n - repeated),
    ]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, x: array<double>), one for each row of docs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) for t in common.texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"]
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.mapped(chosen, each, "doc_id long, x array<double>")


@dataclass
class Model:
    """What scoring needs; a few thousand numbers whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return lifted((x - self.mean) / self.scale, self.waves, self.phases) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.cuts, self.values), 0, 1)


def lifted(x: np.ndarray, waves: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features, whose products approximate a Gaussian kernel, and a constant."""
    z = np.cos(np.clip(x, -8, 8) @ waves + phases) * np.sqrt(2 / len(phases))
    return np.column_stack([z, np.ones(len(x))])


def _summed(rows: DataFrame, make, columns: int) -> np.ndarray:
    """The sum of make(batch)'s arrays over all rows: by partition, then in GROUPS[0] and GROUPS[1] tasks.

    Each sum reads one array at a time, and the driver gets GROUPS[1] of them. With more
    partitions than PARTS and four for each core, a task takes several.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(columns)
        for batch in batches:
            if batch.num_rows:
                total += make(batch)
        yield _sums(TaskContext.get().partitionId(), total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(columns), 0
        for batch in batches:
            for number, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += np.frombuffer(sums.as_buffer())
                part = number
        yield _sums(part, total)

    schema = "part long, sums binary"
    most = max(PARTS, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    found = rows.coalesce(most).mapInArrow(parts, schema)
    for groups in GROUPS:
        found = found.withColumn("part", F.col("part") % groups).groupBy("part").applyInArrow(added, schema)
    return sum((np.frombuffer(r.sums) for r in found.collect()), np.zeros(columns))


def _sums(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"]
    )


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to values in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, n1 = blocks.pop()
            v0, w0, n0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, n0 + n1])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(training: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model:
    """A model of training(x array<double>, y double, part int in 0..FOLDS-1), all of whose rows count.

    One pass sums moments, one the normal equations of each part. A part's raw scores for the
    calibration come from the equations of the others. Without rows, every score is 0.5.
    """
    k = len(STATISTICS)

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return x, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y, _ = of(batch)
        return np.r_[len(y), x.sum(0), (x * x).sum(0)]

    training = training.select("x", F.col("y").cast("double"), F.col("part").cast("int"))
    total = _summed(training, moments, 1 + 2 * k)
    rng = np.random.default_rng(SEED)
    waves, phases = rng.standard_normal((k, features)) / width, rng.uniform(0, 2 * np.pi, features)
    d = features + 1
    n = total[0]
    mean = total[1 : k + 1] / max(n, 1)
    scale = np.sqrt(np.maximum(total[k + 1 :] / max(n, 1) - mean**2, 0))
    scale[scale < 1e-9] = 1
    blank = Model(mean, scale, waves, phases, np.zeros(d), np.array([0.0]), np.array([0.5]))
    if not n:
        return blank
    block = d * d + d

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        x, y, part = of(batch)
        z, out = lifted((x - mean) / scale, waves, phases), np.zeros(FOLDS * block)
        for p in range(FOLDS):
            mine = z[part == p]
            out[p * block : (p + 1) * block] = np.r_[(mine.T @ mine).ravel(), mine.T @ y[part == p]]
        return out

    sums = _summed(training, equations, FOLDS * block).reshape(FOLDS, block)

    def solved(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[: d * d].reshape(d, d) + ridge * np.eye(d), s[d * d :])

    whole = sums.sum(0)
    weights = solved(whole)
    others = np.array([solved(whole - s) for s in sums])

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        x, y, part = of(batch)
        raw = (lifted((x - mean) / scale, waves, phases) * others[part]).sum(1)
        at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        return np.r_[np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)]

    count, ones, raws = _summed(training, bins, 3 * BINS).reshape(3, BINS)
    full = count > 0
    cuts = raws[full] / count[full]
    values = isotonic(ones[full] / count[full], count[full])
    return Model(mean, scale, waves, phases, weights, cuts, values)


def scored(described_docs: DataFrame, model: Model, others: tuple[str, ...] = ()) -> DataFrame:
    """described_docs' rows as (doc_id, *others, score)."""
    k = len(STATISTICS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            score = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], "score"]
            )

    chosen = described_docs.select("x", "doc_id", *others)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(each, f"{schema}, score double")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """Rows (doc_id, y): an id's mean label; rows without id or label don't count."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(column).alias("y"))


@common.tidy
def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, cut: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs.

    Learns labels.quality from the rows that aren't held out (crc32(doc_id as text) mod 5 is
    0 by default) and reads nothing but texts for a score. Null and empty texts have zero
    statistics, very long ones count whole; repeated rows and ids are scored one by one and,
    if labelled, count as often; without any label each score is 0.5. An empty table gives no
    rows. Other columns of docs aren't read.
    """
    out = common.fold("doc_id", 5) == 0 if held_out is None else held_out
    rows = common.stored(described(docs)).withColumn("held_out", out)
    known = rows.where("not held_out").join(labelled(labels, "quality"), "doc_id")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("part")
    model = fit(common.stored(known.select("x", "y", part)))
    found = scored(rows, model, ("held_out",))
    return found.withColumn("predicted", (F.col("score") >= cut).cast("int"))
