"""Near-duplicate embeddings by int8 tile products with error bounds.

A unit vector u is s q + e with q of 8-bit integers. |u.v - s_u s_v q_u.q_v| is at most
|e_v| + |e_u| |s_v q_v|, so a pair whose product less bound reaches the threshold is a link,
one whose product plus bound is below it isn't, and only the others are recomputed in double
precision. Tiles hold 8-bit rows and bounds alone; the full vectors are fetched for those that
have a pair to be recomputed. Equal vectors are one, with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm import common

COSINE = 0.98
#: Distinct vectors of a tile. A task holds two tiles.
TILE = 8192
#: Rows of a product and pairs of a recomputation at a time, which bound memory.
ROWS, PAIRS = 256, 16_384
#: What a link adds to its vectors, and a forest of a tile pair's links.
FOUND = "node long, links long, other long"


def scaled(x: np.ndarray) -> np.ndarray:
    """x's rows by powers of two, so that the largest component is about 1: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of x's rows: steps, 8-bit integers, norms of what rounding left and of what it kept."""
    x = scaled(x)
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    step = np.abs(unit).max(1) / 127
    q = np.rint(unit / step[:, None])
    kept = q * step[:, None]
    return unit, step, q.astype(np.int8), np.sqrt(((unit - kept) ** 2).sum(1)), np.sqrt((kept * kept).sum(1))


class Tile:
    """Vectors of a tile as integers with steps and bounds; in full precision where that was fetched."""

    def __init__(self, frame) -> None:
        self.node, self.n = frame["node"].to_numpy(), frame["n"].to_numpy()
        self.q = np.stack([np.frombuffer(q, np.int8) for q in frame["q"]]) if len(frame) else np.zeros((0, 0), np.int8)
        self.step, self.left, self.kept = (frame[c].to_numpy() for c in ("step", "left", "kept"))
        self.x = scaled(np.stack(frame["x"].to_numpy()).astype(np.float64)) if "x" in frame and len(frame) else None


def products(a: Tile, b: Tile, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks (i, j, sure) of the pairs of rows that may reach `cosine`, and which of them do for certain.

    What a pair is told doesn't depend on the others: products of integers are exact.
    """
    # of 8-bit integers, whole numbers that float32 sums exactly up to 2^24
    kind = np.float32 if a.q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    right = b.q.astype(kind).T
    for at in range(0, len(a.q), ROWS):
        rows = slice(at, at + ROWS)
        near = (a.q[rows].astype(kind) @ right).astype(np.float64) * a.step[rows, None] * b.step
        bound = b.left + a.left[rows, None] * b.kept + 1e-9
        i, j = np.nonzero(near + bound >= cosine)
        yield i + at, j, (near - bound)[i, j] >= cosine


def reach(a: Tile, i: np.ndarray, b: Tile, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows have cosine at least `cosine` in double precision."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), PAIRS):
        x, y = a.x[i[k : k + PAIRS]], b.x[j[k : k + PAIRS]]
        norms = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))
        out[k : k + PAIRS] = (x * y).sum(1) / norms >= cosine
    return out


class Links:
    """Counts of links by vector, and a forest of them, of one tile or two."""

    def __init__(self, a: Tile, b: Tile) -> None:
        self.a, self.b, self.same = a, b, a is b
        self.of_a, self.of_b = np.zeros(len(a.node), np.int64), np.zeros(len(b.node), np.int64)
        self.shift = 0 if self.same else len(a.node)
        self.forest = Forest(self.shift + len(b.node))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.of_a, i, self.b.n[j])
        if not self.same:
            np.add.at(self.of_b, j, self.a.n[i])
        self.forest.join(i, j + self.shift)

    def nodes(self) -> np.ndarray:
        return self.a.node if self.same else np.concatenate([self.a.node, self.b.node])

    def counts(self) -> np.ndarray:
        return self.of_a if self.same else np.concatenate([self.of_a, self.of_b])

    def others(self) -> np.ndarray:
        return self.nodes()[self.forest.roots()]


def _halves(frame) -> tuple[Tile, Tile]:
    """The two tiles of a group, which are one where a tile meets itself."""
    a = Tile(frame[frame["t"] == frame["t1"]])
    return a, a if frame["t1"].iloc[0] == frame["t2"].iloc[0] else Tile(frame[frame["t"] == frame["t2"]])


def distinct_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """rows(id, label, vector) with the key of its class: label and components; null if it can't link."""
    x = F.col(vector_col)
    good = F.col(label_col).isNotNull() & x.isNotNull()
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    key = F.sha2(F.concat_ws("|", F.col(label_col).cast("string"), x.cast("string")), 256)
    linkable = good & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))
    return rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        x.alias("x"),
        F.when(linkable, key).alias("key"),
    )


def _coded(classes: DataFrame) -> DataFrame:
    """classes(node, n, label, x) as rows (node, n, label, dim, q, step, left, kept)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["q", "step", "left", "kept"]
        for batch in batches:
            x, size = batch.column(0), batch.num_rows
            out: list[list] = [[None] * size for _ in names]
            lengths = x.value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                mine = np.flatnonzero(lengths == length)
                flat = x.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False)
                _, step, q, left, kept = quantised(flat.astype(np.float64).reshape(len(mine), length))
                for k, at in enumerate(mine.tolist()):
                    out[0][at], out[1][at], out[2][at], out[3][at] = q[k].tobytes(), step[k], left[k], kept[k]
            coded = [pa.array(out[0], pa.binary()), *(pa.array(o, pa.float64()) for o in out[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *coded], names=[*batch.schema.names[1:], *names])

    chosen = classes.select("x", "node", "n", "label", F.size("x").alias("dim"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return common.mapped(chosen, each, f"{schema}, q binary, step double, left double, kept double")


@common.tidy
def near_duplicates(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    tile: int = TILE,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row.

    Vectors of equal label and length link from `cosine` on. Vectors that are null, empty, zero
    or hold a null or non-finite component, and those without a label, link with nothing: no
    links, a component of their own. Rows that repeat a vector link with each other. A null id
    is no component's id unless it has no other. An empty table gives no rows. Other columns
    aren't read.
    """
    marked = common.stored(distinct_vectors(rows, id_col, vector_col, label_col))
    linkable = marked.where("key is not null")
    classes = linkable.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min("vec_id").alias("least"),
        F.first("label").alias("label"),
        F.first("x").alias("x"),
    )
    # numbers given as the table is written are unique, whichever vectors there are
    classes = common.stored(classes.withColumn("node", F.monotonically_increasing_id()))
    coded = common.stored(_coded(classes))
    group = ["label", "dim"]
    counts = common.stored(coded.groupBy(*group).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    dealt = coded.join(counts, group).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")
    paired = dealt.select(*coded.columns, "t", other).withColumns({"t1": F.least("t", "o"), "t2": F.greatest("t", "o")})
    keys = [*group, "t1", "t2"]
    place = f"label {coded.schema['label'].dataType.simpleString()}, dim int, t1 int, t2 int, t int"

    def screened(frame):
        """Links that the integers prove; vectors with a pair that they can't tell are marked."""
        import pandas as pd

        a, b = _halves(frame)
        links, asks = Links(a, b), np.zeros(len(a.node) + (0 if a is b else len(b.node)), bool)
        for i, j, sure in products(a, b, cosine) if len(a.node) and len(b.node) else ():
            if links.same:
                i, j, sure = i[i != j], j[i != j], sure[i != j]
            links.add(i[sure], j[sure])
            asks[i[~sure]] = asks[j[~sure] + links.shift] = True
        columns = {c: frame[c].iloc[0] for c in ("label", "dim", "t1", "t2")}
        sides = np.r_[[columns["t1"]] * len(a.node), [columns["t2"]] * (len(asks) - len(a.node))]
        out = pd.DataFrame({"node": links.nodes(), "links": links.counts(), "other": links.others(), "asks": asks})
        out = out.assign(**columns, t=sides)
        return out[(out["links"] > 0) | out["asks"]]

    def recomputed(frame):
        """Links among the pairs of marked vectors that the integers can't tell."""
        import pandas as pd

        a, b = _halves(frame)
        links = Links(a, b)
        for i, j, sure in products(a, b, cosine) if len(a.node) and len(b.node) else ():
            open_pairs = ~sure & (i != j) if links.same else ~sure
            i, j = i[open_pairs], j[open_pairs]
            real = reach(a, i, b, j, cosine)
            links.add(i[real], j[real])
        out = pd.DataFrame({"node": links.nodes(), "links": links.counts(), "other": links.others()})
        return out[out["links"] > 0]

    first = common.stored(paired.groupBy(*keys).applyInPandas(screened, f"{FOUND}, asks boolean, {place}"))
    asked = first.where("asks").select(*keys, "t", "node")
    asked = asked.join(coded.drop(*group), "node").join(classes.select("node", "x"), "node")
    second = common.stored(asked.groupBy(*keys).applyInPandas(recomputed, FOUND))
    found = first.where("links > 0").select("node", "links", "other").union(second)
    roots = common.components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("key", "node", "n", "least").join(linked, "node", "left").join(roots, "node", "left")
    known = common.stored(known.select("key", "n", "least", "links", F.coalesce("root", "node").alias("root")))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = F.col("n") - 1 + F.coalesce("links", F.lit(0))
    of = common.stored(known.join(named, "root").select("key", n_links.alias("n_links"), "component_id"))
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = marked.select("vec_id", "key").join(of, "key", "left")
    out = out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


class Forest:
    """Sets of numbers 0 to n-1, joined by pairs; roots are the smallest numbers."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self._top(a), self._top(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))

    def _top(self, x: np.ndarray) -> np.ndarray:
        x = self.root[x]
        while not np.array_equal(up := self.root[x], x):
            x = up
        return x

    def roots(self) -> np.ndarray:
        return self._top(np.arange(len(self.root)))
