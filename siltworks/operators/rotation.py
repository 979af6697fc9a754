"""Keyword rotation: one slot runs at a time, for its duration, in a circle."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_EXTENSIONS, LONGEST_EXTENSION_MS, EXTENSION_BUFFER_MS = 3, 600_000, 30_000


@dataclass(frozen=True)
class Slot:
    brand_id: int
    keyword: str
    duration_ms: int
    paused: bool = False


@dataclass(frozen=True)
class Rotation:
    """The state of a workspace's rotation: a small record, so it's a value and not a table."""

    slots: tuple[Slot, ...] = ()
    current: int = -1
    ends_at: int | None = None
    token: int = 0
    extensions: int = 0
    cycles: int = 0
    enabled: bool = True
    busy: frozenset = field(default_factory=frozenset)

    def started(self, first: int, now: int) -> Rotation:
        """The next slot from `first` on that is neither paused nor busy elsewhere runs; without any the rotation stops."""
        n = len(self.slots)
        for k in range(n):
            i = (first + k) % n
            s = self.slots[i]
            if not s.paused and (s.brand_id, s.keyword) not in self.busy:
                return replace(self, current=i, ends_at=now + s.duration_ms, token=self.token + 1, extensions=0)
        return replace(self, enabled=False, ends_at=None, token=self.token + 1)

    def advanced(self, now: int, token: int | None = None, paused_until: int | None = None) -> Rotation:
        """What the end of a slot brings: nothing for a stale token, more time while the quota is used up, else the next slot."""
        if not self.enabled or not self.slots or token not in (None, self.token):
            return self
        if paused_until is not None and self.current >= 0 and self.extensions < MOST_EXTENSIONS:
            wait = min(max(0, paused_until - now) + EXTENSION_BUFFER_MS, LONGEST_EXTENSION_MS)
            return replace(self, ends_at=now + wait, token=self.token + 1, extensions=self.extensions + 1)
        slots = tuple(replace(s, paused=True) if i == self.current else s for i, s in enumerate(self.slots))
        after = (self.current + 1) % len(slots)
        return replace(self, slots=slots, cycles=self.cycles + (after == 0)).started(after, now)

    def added(self, new: tuple[Slot, ...]) -> Rotation:
        """Slots whose brand and keyword, without regard to case, aren't there yet."""
        known = {(s.brand_id, s.keyword.lower()) for s in self.slots}
        fresh = []
        for s in new:
            if (s.brand_id, s.keyword.lower()) not in known:
                known.add((s.brand_id, s.keyword.lower()))
                fresh.append(s)
        return replace(self, slots=self.slots + tuple(fresh))

    def removed(self, i: int, now: int) -> Rotation:
        slots = self.slots[:i] + self.slots[i + 1 :]
        if not slots:
            return replace(self, slots=(), current=-1, ends_at=None, enabled=False)
        if i == self.current:
            return replace(self, slots=slots, current=-1).started(i % len(slots), now)
        return replace(self, slots=slots, current=self.current - (i < self.current))

    def paused(self, i: int, now: int) -> Rotation:
        out = replace(self, slots=tuple(replace(s, paused=True) if k == i else s for k, s in enumerate(self.slots)))
        return out.started((i + 1) % len(self.slots), now) if i == self.current and self.enabled else out

    def resumed(self, i: int, now: int) -> Rotation:
        out = replace(self, slots=tuple(replace(s, paused=False) if k == i else s for k, s in enumerate(self.slots)))
        return out if out.enabled else replace(out, enabled=True).started(i, now)

    def recovered(self, now: int, grace_ms: int = 60_000) -> Rotation:
        """A rotation whose end passed without being advanced goes on."""
        return self.advanced(
            now
        ) if self.enabled and self.ends_at is not None and now > self.ends_at + grace_ms else self


def schedule(slots: DataFrame, start_ms: Column) -> DataFrame:
    """slots(workspace_id, ord, keyword, duration_ms, paused) with when each runs in the first round: a running sum."""
    rows = slots.where("not paused")
    before = F.coalesce(
        F.sum("duration_ms").over(
            Window.partitionBy("workspace_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    return rows.withColumn("starts", start_ms + before).withColumn("ends", F.col("starts") + F.col("duration_ms"))
