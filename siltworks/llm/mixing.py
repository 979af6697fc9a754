"""Mixing sources to target weights by entropy balancing.

Of all rates 0 to MOST at which documents may be taken so that the tokens of each source reach
their target, those nearest to the corpus in relative entropy are w = min(MOST, exp(l z)) for a
document of z words (in units of its source's mean), where l, one number a source, maximises a
concave dual. Newton steps find l from sums over the corpus; the rates are then rounded into
copies by error diffusion over the sizes of a source.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltworks.llm import common

#: Weights of the sources by code point, repeating; the most copies of a document.
WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Parts in which rows that are alike are counted and written out again.
SALTS = 256
#: The relative error of a source's tilted tokens at which steps end, and the most of them.
TOLERANCE, MAX_STEPS = 1e-9, 100
#: Sums of tilted tokens are exact to this type, so they don't depend on the order of rows.
_EXACT = "decimal(38,6)"


def _size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _order() -> Column:
    """A row's place among those of equal size: the key of id and text, as hexadecimal digits."""
    return F.hex(common.row_key("doc_id", "text"))


def sized(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, h): the words of each text, and what orders equal sizes."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        _size().alias("size"),
        _order().alias("h"),
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources(source, source_size) with target: shares of the sum by weight, at most `most` times the size.

    What exceeds a source's most goes to the others by weight, until none is above: those
    below it all get weight times one level, found from sums over the sources in the order
    in which they fill up. A row of each source is all that meets here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(
        F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1
    )
    cap = (F.col("source_size") * most).cast("double")
    filling = Window.orderBy(cap / F.col("w"), "source")
    whole = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    found = sources.withColumn("w", w).withColumn("cap", cap).withColumn("level", level)
    open_at = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))
    first = F.min(open_at).over(whole)
    found = found.withColumn("level", F.coalesce(first["level"], F.lit(0.0)))
    return found.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def balanced(histogram: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """goals(source, source_size, target) with l and unit, from histogram(source, size, n).

    A document of `size` words then has the rate min(most, exp(l size / unit)), and a source's
    rates times sizes sum to its target. Each step sums, by source, the tilted words and their
    slope, which are the dual's gradient and curvature. Steps are Newton's on the logarithm of
    the sum, halved into the bounds on l that the signs of the sums before it give: the sum
    grows with l, is above the target at l = 0 or below it at the l of which even the smallest
    text is taken `most` times. Sources without a target or without words aren't balanced; their
    l is null. It is an error if steps don't end.
    """
    unit = F.sum(F.col("size") * F.col("n")) / F.sum("n")
    words = histogram.where("size > 0").groupBy("source").agg(unit.alias("unit"), F.min("size").alias("least"))
    words = words.withColumnRenamed("source", "s")
    start = goals.where("target > 0").join(words, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    top = F.lit(math.log(most)) * F.col("unit") / F.col("least")
    above = F.col("target") >= F.col("source_size")
    now = start.select(
        "source",
        "target",
        "unit",
        F.when(F.col("target") >= F.col("source_size") * most * (1 - 1e-12), top).otherwise(F.lit(0.0)).alias("l"),
        F.when(above, F.lit(0.0)).otherwise(F.lit(-math.inf)).alias("low"),
        F.when(above, top).otherwise(F.lit(0.0)).alias("high"),
        F.lit(False).alias("done"),
    )
    now = common.stored(now)
    for _ in range(MAX_STEPS):
        left = now.where("not done").withColumnRenamed("source", "s")
        z = F.col("size") / F.col("unit")
        rate = F.least(F.lit(float(most)), F.exp(F.col("l") * z))
        tilted = (
            histogram.where("size > 0")
            .join(left, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("mass", F.col("size") * F.col("n") * rate)
            .withColumn("slope", F.when(rate < most, F.col("mass") * z).otherwise(0.0))
            .groupBy("source", "target", "unit", "l", "low", "high")
            .agg(*(F.sum(F.col(c).cast(_EXACT)).cast("double").alias(c) for c in ("mass", "slope")))
        )
        off = F.col("mass") / F.col("target") - 1
        low = F.when(off < 0, F.col("l")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("l")).otherwise(F.col("high"))
        short = F.log(F.try_divide(F.col("target"), F.col("mass")))
        stepped = F.col("l") + short * F.try_divide(F.col("mass"), F.col("slope"))
        middle = F.when(F.col("low") == -math.inf, 2 * F.col("high") - 1).otherwise((F.col("low") + F.col("high")) / 2)
        within = (stepped > F.col("low")) & (stepped < F.col("high"))
        after = tilted.withColumns({"off": off, "low": low, "high": high}).withColumn(
            "done", (F.abs("off") <= TOLERANCE) | (F.col("high") - F.col("low") < 1e-14 * F.abs("high"))
        )
        after = after.withColumn("l", F.when(F.col("done"), F.col("l")).when(within, stepped).otherwise(middle))
        after = common.stored(now.where("done").unionByName(after.select(*now.columns)))
        common.drop_stored(now)
        now = after
        if not now.where("not done").take(1):
            break
    else:
        raise RuntimeError(f"sources aren't balanced after {MAX_STEPS} steps")
    found = now.select(F.col("source").alias("s"), "l", "unit")
    return goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def diffused(histogram: DataFrame, balance: DataFrame, most: int = MOST) -> DataFrame:
    """histogram(source, size, n) with base copies and `extra` documents that get one more.

    Of each source, sizes come from the largest; what rounding leaves over is carried on, so
    that the source's words miss their target by about half of its smallest documents at most.
    Documents without words are taken once; those of a source without a balance never. A source's distinct
    sizes, not its documents, meet in a task.
    """

    def spread(frame):
        import pandas as pd

        frame = frame.sort_values("size", ascending=False)
        tilt, unit = float(frame["l"].iloc[0]), float(frame["unit"].iloc[0])
        carry, copies = 0.0, []
        for size, n in zip(frame["size"].tolist(), frame["n"].tolist(), strict=True):
            if not size or math.isnan(tilt):
                copies.append(0 if size else n)
                continue
            carry += min(float(most), math.exp(min(tilt * size / unit, 50.0))) * size * n
            copies.append(int(min(most * n, max(0, math.floor(carry / size + 0.5)))))
            carry -= copies[-1] * size
        base, extra = np.divmod(np.array(copies, np.int64), frame["n"].to_numpy())
        columns = {"source": frame["source"], "size": frame["size"], "n": frame["n"], "base": base, "extra": extra}
        return pd.DataFrame(columns)

    found = balance.select(F.col("source").alias("s"), "l", "unit")
    joined = histogram.join(found, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return joined.groupBy("source").applyInPandas(spread, "source string, size long, n long, base int, extra long")


def _cell(h: Column, cells: Column) -> Column:
    """The cell of h when its range is cut into equal ones: hashes in order, so cells are in order too."""
    return F.floor(F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48) * cells).cast("long")


def planned(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Of rows(source, size, h): a stored row of each source and size, which says what its rows get.

    Columns _s, _z, source_size, target, base, last, _some, _same: a row gets `base` copies, and
    one more if its h is below `last`; of the _same rows whose h is `last`, _some do. This takes
    no ranks of all rows: the rows of a class are counted in cells by h, as many as the root of
    their number, and only the cell in which its extra copies run out is ranked.
    """
    histogram = common.stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    balance = common.stored(balanced(histogram, common.stored(targets(sources, weights, most)), most))
    of_source = balance.select(F.col("source").alias("s"), "source_size", "target")
    plan = diffused(histogram, balance, most).join(of_source, F.col("source").eqNullSafe(F.col("s")))
    plan = common.stored(
        plan.select(
            F.col("source").alias("_s"),
            F.col("size").alias("_z"),
            "source_size",
            "target",
            "base",
            "extra",
            F.ceil(F.sqrt("n")).cast("long").alias("cells"),
        )
    )
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    dealt = rows.join(plan.where("extra > 0").select("_s", "_z", "extra", "cells"), same)
    dealt = dealt.select("_s", "_z", "extra", "h", _cell(F.col("h"), F.col("cells")).alias("cell"))
    turn = Window.partitionBy("_s", "_z").orderBy("cell")
    counts = dealt.groupBy("_s", "_z", "extra", "cell").agg(F.count("*").alias("k"))
    counts = counts.withColumn("upto", F.sum("k").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    edge = counts.where("upto >= extra and upto - k < extra")
    edge = common.stored(
        edge.select(
            F.col("_s").alias("s"), F.col("_z").alias("z"), F.col("cell").alias("c"),
            (F.col("extra") - F.col("upto") + F.col("k")).alias("give"),
        )
    )
    at_edge = F.col("_s").eqNullSafe(F.col("s")) & (F.col("_z") == F.col("z")) & (F.col("cell") == F.col("c"))
    # rows alike are one with a count, so a cell has few however often they repeat
    ranked = dealt.join(edge, at_edge).groupBy("_s", "_z", "give", "h").agg(F.count("*").alias("m"))
    rank = Window.partitionBy("_s", "_z").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("upto", F.sum("m").over(rank)).where("upto >= give and upto - m < give")
    last = ranked.select(
        F.col("_s").alias("s"), F.col("_z").alias("z"), F.col("h").alias("last"),
        (F.col("give") - F.col("upto") + F.col("m")).alias("_some"), F.col("m").alias("_same"),
    )
    mine = F.col("_s").eqNullSafe(F.col("s")) & (F.col("_z") == F.col("z"))
    return common.stored(plan.drop("extra", "cells").join(last, mine, "left").drop("s", "z"))


def _with_copies(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(source, size, h, ...) with `copies`, and those whose copies depend on their like instead."""
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    found = rows.join(plan, same).drop("_s", "_z")
    shared = F.coalesce((F.col("h") == F.col("last")) & (F.col("_some") < F.col("_same")), F.lit(False))
    more = F.coalesce(F.col("h") <= F.col("last"), F.lit(False)).cast("int")
    sure = found.where(~shared).withColumn("copies", F.col("base") + more)
    return sure.drop("last", "base", "_some", "_same"), found.where(shared)


def _salt() -> Column:
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("_salt")


def _shared_out(kinds: DataFrame, *more: str) -> DataFrame:
    """kinds(source, size, h, _salt, base, _some, k, *more) with `gone`, the rows of equal h before them."""
    place = "source", "size", "h", *more, "_salt"
    before = Window.partitionBy("source", "size", "h").orderBy(*more, "_salt")
    gone = F.coalesce(F.sum("k").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("gone")
    found = kinds.select(F.struct(*place).alias("_at"), gone)
    return kinds.join(found, F.struct(*place).eqNullSafe(F.col("_at"))).drop("_at")


@common.tidy
def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken), one for each row of docs.

    Null texts have size 0; documents without words are taken once, as no target speaks of
    them; very long texts count whole. A null source is a source, the last. Repeated rows are
    rows; which of equal size get one copy more is decided by a hash of id and text, so reruns
    agree. An empty table gives no rows. Columns other than doc_id, source and text aren't read.
    """
    rows = common.stored(sized(docs))
    plan = planned(rows, weights, most)
    sure, shared = _with_copies(rows, plan)
    if plan.where("_some < _same").take(1):
        # rows alike in id, source and text: counted in parts, and written out again with their copies
        alike = "doc_id", "source", "size", "source_size", "target", "h", "base", "_some"
        kinds = common.stored(shared.select(*alike, _salt()).groupBy(*alike, "_salt").agg(F.count("*").alias("k")))
        each = _shared_out(kinds).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
        copies = F.col("base") + (F.col("gone") + F.col("j") <= F.col("_some")).cast("int")
        sure = sure.unionByName(each.withColumn("copies", copies).select(*sure.columns))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return sure.select("doc_id", "source", "size", "source_size", "target", "copies", taken)


@common.tidy
def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs' rows, each as often as mixed() takes it, with the columns they had.

    Texts stay where they are read, unless the plan of sources and sizes is too large to be
    broadcast. Rows alike in id, source and text that don't all get the same share their copies
    out by a hash of all columns, so reruns agree. Nulls, empty and very long texts are as in
    mixed(); an empty table stays empty.
    """
    rows = common.packed(
        docs, F.col("source").cast("string").alias("source"), _size().alias("size"), _order().alias("h")
    )
    plan = planned(common.stored(rows.drop("_row")), weights, most)
    sure, shared = _with_copies(rows, plan)
    out = sure.where("copies > 0").select("_row", F.col("copies").cast("int").alias("_take"))
    if plan.where("_some < _same").take(1):
        whole = F.md5(F.to_json("_row").cast("binary")).alias("_whole")
        kinds = shared.select("source", "size", "h", "base", "_some", whole, _salt(), "_row")
        kinds = kinds.groupBy("source", "size", "h", "base", "_some", "_whole", "_salt")
        kinds = _shared_out(common.stored(kinds.agg(F.count("*").alias("k"), F.first("_row").alias("_row"))), "_whole")
        more = F.greatest(F.lit(0), F.least(F.col("k"), F.col("_some") - F.col("gone")))
        take = (F.col("base") * F.col("k") + more).cast("int").alias("_take")
        out = out.union(kinds.select("_row", take).where("_take > 0"))
    times = F.explode(F.array_repeat(F.lit(1), F.col("_take")))
    return out.select("_row", times.alias("_t")).select("_row.*")
