"""Progress events and quotas, as streams where state or lateness matters and as batch twins of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from siltworks.functions import constants as K
from siltworks.operators.scoring import half_up

THROTTLE_MS, DEDUP, BUDGET_LATENESS, PAUSE_AT, RESUME_ABOVE = 500, "3 minutes", "48 hours", 5, 20


def after_seq(events: DataFrame, seq: int, by: str = "scan_id") -> DataFrame:
    """Events after a sequence number, one of each number: of repeats the first by time."""
    rows = events.where(F.col("seq") > seq)
    return rows.groupBy(by, "seq").agg(F.min(F.struct("ts", "status")).alias("e")).select(by, "seq", "e.ts", "e.status")


def distinct_stream(events: DataFrame, keys: list[str], at: str = "ts", within: str = DEDUP) -> DataFrame:
    """A stream without events whose keys were seen shortly before."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def _stretches(rows: DataFrame, keys: list[str], ms: Column, gap_ms: int) -> DataFrame:
    """rows with `_ms` and `_stretch`: rows of a key in different stretches are more than gap_ms apart.

    Time is cut into pieces of gap_ms; where one is empty, a stretch ends. Only the distinct
    pieces of a key are put in order, not its rows.
    """
    rows = rows.withColumn("_ms", ms).withColumn("_piece", F.floor(F.col("_ms") / gap_ms))
    pieces = rows.select(*keys, "_piece").distinct()
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("_piece"))
    pieces = pieces.withColumn("_stretch", F.col("_piece") - turn)
    return rows.join(pieces, [*keys, "_piece"]).drop("_piece")


def deduplicated(searches: DataFrame, keys: list[str], at: str = "ts", within_ms: int = 180_000) -> DataFrame:
    """searches with `hit`: whether an equal one was fetched at most within_ms before. The cached answer's age counts.

    Hits don't renew the answer, so times are walked through, holding one number; a key's walk
    is cut wherever it is idle for within_ms, as the next search is fetched then in any case.
    Rows without a time or with a null among the keys go.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_us", "event_id"])
        hit, last = [], None
        for t in frame["_ms"].tolist():
            fresh = last is not None and t - last < within_ms
            hit.append(fresh)
            last = last if fresh else t
        return pd.DataFrame({"event_id": frame["event_id"], "hit": hit})

    us = F.unix_micros(F.col(at).cast("timestamp"))
    rows = searches.select("event_id", *keys, us.alias("_us"))
    cut = _stretches(rows, keys, F.floor(F.col("_us") / 1000), within_ms)
    return cut.groupBy(*keys, "_stretch").applyInPandas(walk, "event_id long, hit boolean")


def daily_budget(calls: DataFrame, by: str = "workspace_id", at: str = "ts") -> DataFrame:
    """Calls of each group by UTC day; on a stream, days close 48 hours later."""
    rows = calls.withWatermark(at, BUDGET_LATENESS) if calls.isStreaming else calls
    return rows.groupBy(by, F.window(at, "1 day").alias("w")).agg(F.count("*").alias("used")).select(
        by, F.date_format("w.start", "yyyy-MM-dd").alias("day"), "used"
    )


def throttled(events: DataFrame, by: str = "scan_id", at: str = "ts", ms: int = THROTTLE_MS) -> DataFrame:
    """The last event of each window of time, and every terminal one."""
    window = F.window(at, f"{ms} milliseconds")
    last = events.groupBy(by, window).agg(F.max_by(F.struct(*events.columns), F.struct(at, "seq")).alias("e")).select(
        "e.*"
    )
    terminal = events.where(F.col("status").isin(*K.TERMINAL_STATUSES))
    return last.unionByName(terminal).dropDuplicates([by, "seq"])


def throttled_stream(events: DataFrame, ms: int = THROTTLE_MS) -> DataFrame:
    """Stream of (scan_id, seq, status): an event passes if none did for `ms`, or if it's terminal; a held one passes when time is up.

    State is one held event a scan; events(scan_id string, seq long, ts timestamp, status string).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = state.get if state.exists else (None, None)
        out: list[tuple] = []
        if state.hasTimedOut:
            if held is not None:
                out.append(tuple(held))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("seq")
            for seq, ts, status in zip(
                rows["seq"], rows["ts"].astype("datetime64[us]").astype("int64") // 1000, rows["status"], strict=True
            ):
                if status in K.TERMINAL_STATUSES or last is None or ts - last >= ms:
                    out.append((int(seq), status))
                    last, held = int(ts), None
                else:
                    held = (int(seq), status)
            state.update((last, held))
            state.setTimeoutDuration(ms)
        yield pd.DataFrame({"scan_id": [key[0]] * len(out), "seq": [o[0] for o in out], "status": [o[1] for o in out]})

    return events.groupBy("scan_id").applyInPandasWithState(
        step, "scan_id string, seq long, status string", "last long, held struct<seq:long,status:string>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def merged(snapshot: DataFrame, live: DataFrame, by: str = "scan_id") -> DataFrame:
    """A snapshot and what came after it, up to a scan's first terminal event."""
    rows = snapshot.unionByName(live).dropDuplicates([by, "seq"])
    ends = rows.where(F.col("status").isin(*K.TERMINAL_STATUSES)).groupBy(by).agg(F.min("seq").alias("_end"))
    return rows.join(ends, by, "left").where("_end is null or seq <= _end").drop("_end")


def sticky_status(events: DataFrame, by: str = "scan_id") -> DataFrame:
    """Each scan's status: its first terminal one if there is any, else its last."""
    done = F.col("status").isin(*K.TERMINAL_STATUSES)
    out = events.groupBy(by).agg(
        F.min_by(F.when(done, F.col("status")), F.when(done, F.col("seq"))).alias("t"),
        F.max_by("status", "seq").alias("l"),
    )
    return out.select(by, F.coalesce("t", "l").alias("status"))


def percent(
    status: Column,
    phase: Column,
    queries: tuple[Column, Column],
    repos: tuple[Column, Column, Column],
) -> Column:
    """0 to 100 from a scan's state, (queries in all, done) and (repositories in all, discovered, processed)."""
    total = F.when(F.coalesce(repos[0], F.lit(0)) != 0, repos[0]).otherwise(F.coalesce(repos[1], F.lit(0)))
    share = lambda part, whole: F.when(
        whole > 0, F.least(F.lit(1.0), F.greatest(F.lit(0), part) / F.when(whole > 0, whole))
    ).otherwise(F.lit(0.0))
    search, analysis = share(queries[1], queries[0]), share(repos[2], total)
    ended = F.when(repos[2] > 0, repos[2] / F.greatest(total, F.lit(1)) * 90 + 5).when(
        phase == "queued", 0.0
    ).otherwise(5.0)
    return (
        F.when(status.isin("completed", "partially_completed") | (phase == "completed"), 100)
        .when(status.isin("failed", "cancelled") | phase.isin("failed", "cancelled"), F.least(F.lit(99), F.greatest(F.lit(0), half_up(ended))))
        .when(phase == "queued", 0).when(phase == "orchestrating", 5).when(phase == "searching", half_up(5 + search * 30))
        .when(phase.isin("analyzing", "finalizing"), half_up(35 + analysis * 60)).otherwise(F.least(F.lit(95), half_up(5 + search * 30 + analysis * 60)))
    ).cast("int")


def paced(
    requests: DataFrame,
    interval_ms: int,
    by: str = "scope",
    at: str = "ms",
    order: str = "event_id",
) -> DataFrame:
    """requests with `slot`: each at its time or an interval after the one before, all reserved.

    slot_n = max(t_n, slot_(n-1) + m) is a running maximum of t - n m, plus n m.
    """
    w = Window.partitionBy(by).orderBy(at, order)
    n = F.row_number().over(w).cast("long")  # n m is past an int from 35,792 requests a minute apart on
    rows = requests.withColumn("_n", n)
    top = F.max(F.col(at) - F.col("_n") * interval_ms).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("slot", top + F.col("_n") * interval_ms).drop("_n")


def gated(
    requests: DataFrame,
    interval_ms: int,
    most_ms: int,
    by: str = "scope",
    at: str = "ms",
    order: str = "event_id",
) -> DataFrame:
    """Rows (event_id, wait): a slot is only reserved if its wait is at most most_ms.

    A sequential rule, walked holding one number. A slot is reserved at most most_ms after its
    request, so a scope that is idle for most_ms + interval_ms starts afresh: walks are cut there.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_ms", order])
        last, waits = None, []
        for t in frame["_ms"].tolist():
            slot = t if last is None else max(last + interval_ms, t)
            waits.append(slot - t)
            last = slot if slot - t <= most_ms else last
        return pd.DataFrame({order: frame[order], "wait": waits})

    cut = _stretches(requests.select(by, order, at), [by], F.col(at), most_ms + interval_ms)
    return cut.groupBy(by, "_stretch").applyInPandas(walk, f"{order} long, wait long")


def concurrency(changes: DataFrame, by: str = "workspace_id", order: str = "seq") -> DataFrame:
    """changes(+1 or -1 in `delta`) with how many run then, of the group and of all groups of its day."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("running", F.sum("delta").over(w))


def paused(snapshots: DataFrame, by: str = "scope", order: str = "event_id", remaining: str = "remaining") -> DataFrame:
    """snapshots with `paused`: from when little quota remains until clearly more does, the last signal holding in between."""
    signal = F.when(F.col(remaining) <= PAUSE_AT, True).when(F.col(remaining) > RESUME_ABOVE, False)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return snapshots.withColumn("paused", F.coalesce(F.last(signal, ignorenulls=True).over(w), F.lit(False)))


def hourly_counts(events: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type. An addition: the engine's own streams have no event-time windows."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("hour"), "event_type", "n", "total"
    )
