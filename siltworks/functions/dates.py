"""Activity windows, range qualifiers and how ranges are halved."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltworks.functions import constants as K

NARROWEST_SECONDS, NARROWEST_BYTES = 60, 16


def end_of_day(at: Column) -> Column:
    return F.date_trunc("day", at) + F.expr("INTERVAL '0 23:59:59.999' DAY TO SECOND")


def within(at: Column, start: Column | None, stop: Column | None) -> Column:
    """Both bounds count, stop to the end of its day; a missing time fails any bound there is."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & F.coalesce(at >= start, F.lit(False))
    if stop is not None:
        ok = ok & F.coalesce(at <= end_of_day(stop), F.lit(False))
    return ok


def active(created: Column, pushed: Column, created_in: tuple, pushed_in: tuple, mode: str = "and") -> Column:
    """Whether a repository was created and (or) pushed within windows (start, stop) of which either end may be None."""
    sides = [
        within(at, *bounds) for at,
        bounds in ((created, created_in), (pushed, pushed_in)) if any(b is not None for b in bounds)
    ]
    if len(sides) < 2:
        return sides[0] if sides else F.lit(True)
    return sides[0] | sides[1] if mode == "or" else sides[0] & sides[1]


def normal_date(text: Column) -> Column:
    """YYYY-MM-DD of a date or time; null if it is none."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain).otherwise(
        F.date_format(F.try_to_timestamp(plain), "yyyy-MM-dd")
    )


def range_error(start: Column, stop: Column, today: str) -> Column:
    """Why a range of normal dates can't be searched; null if it can."""
    problem = lambda d, what: (
        F.when(d < K.EARLIEST_DATE, f"{what} predates the host").when(d > today, f"{what} is in the future")
    )
    return F.coalesce(problem(start, "start"), problem(stop, "stop"), F.when(start > stop, "start is after stop"))


def qualifier(name: str, start: Column, stop: Column) -> Column:
    """name:start..stop, name:>=start or name:<=stop; null without either."""
    both, one, other = F.concat(F.lit(f"{name}:"), start, F.lit(".."), stop), F.concat(
        F.lit(f"{name}:>="), start
    ), F.concat(F.lit(f"{name}:<="), stop)
    return F.coalesce(both, one, other)


def qualifier_variants(created: Column, pushed: Column, mode: str = "and") -> Column:
    """The qualifiers of one query, or of two where either may hold; none without either."""
    joined = F.concat_ws(" ", created, pushed)
    one = F.when(F.length(joined) > 0, F.array(joined)).otherwise(F.array().cast("array<string>"))
    return F.when(created.isNotNull() & pushed.isNotNull(), F.array(created, pushed)).otherwise(
        one
    ) if mode == "or" else one


_CREATED, _SIZE = r"created:(\S+)\.\.(\S+)", r"size:(\d+)\.\.(\d+)"


def bounded(query: Column, field: str = "created") -> Column:
    """query with an open range of created or size closed, and with the widest range where there is none."""
    low, high = (K.EARLIEST_DATE, K.LATEST_DATE) if field == "created" else ("0", str(K.LARGEST_FILE))
    closed, above, below = (
        (_CREATED, r"created:>=(\S+)", r"created:<=(\S+)") if field == "created" else (
            _SIZE, r"size:>=?(\d+)", r"size:<=?(\d+)"
        )
    )
    first = lambda p, by: F.concat(
        F.substr(query, F.lit(1), F.regexp_instr(query, F.lit(p)) - 1), by, F.substr(query, F.regexp_instr(query, F.lit(p)) + F.length(F.regexp_substr(query, F.lit(p))))
    )
    return (
        F.when(query.rlike(closed), query)
        .when(query.rlike(above), first(above, F.concat(F.lit(f"{field}:"), F.regexp_extract(query, above, 1), F.lit(f"..{high}"))))
        .when(query.rlike(below), first(below, F.concat(F.lit(f"{field}:{low}.."), F.regexp_extract(query, below, 1))))
        .otherwise(F.concat(query, F.lit(f" {field}:{low}..{high}")))
    )


def _in_place(query: Column, pattern: str, by: Column) -> Column:
    at = F.regexp_instr(query, F.lit(pattern))
    return F.concat(
        F.substr(query, F.lit(1), at - 1), by, F.substr(query, at + F.length(F.regexp_substr(query, F.lit(pattern))))
    )


def halved_created(query: Column) -> Column:
    """The query's two halves by creation time, as an array; null if it has no range or one too narrow."""
    start, stop = F.regexp_extract(query, _CREATED, 1), F.regexp_extract(query, _CREATED, 2)
    day = lambda t: t.rlike(r"^\d{4}-\d{2}-\d{2}$")
    millis = lambda t: F.unix_millis(F.try_to_timestamp(t))
    low, high = millis(start), F.when(day(stop), millis(stop) + 86_399_999).otherwise(millis(stop))
    middle = low + F.floor((high - low) / 2)
    iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    first = _in_place(query, _CREATED, F.concat(F.lit("created:"), start, F.lit(".."), iso(middle - 1000)))
    second = _in_place(query, _CREATED, F.concat(F.lit("created:"), iso(middle), F.lit(".."), stop))
    return F.when(query.rlike(_CREATED) & (high - low >= NARROWEST_SECONDS * 1000), F.array(first, second))


def halved_size(query: Column) -> Column:
    """The query's two halves by file size, as an array; null if it has no range or one too narrow."""
    low, high = (F.try_to_number(F.regexp_extract(query, _SIZE, k), F.lit("999999999999")).cast("long") for k in (1, 2))
    middle = low + F.floor((high - low) / 2)
    first = _in_place(query, _SIZE, F.concat(F.lit("size:"), low.cast("string"), F.lit(".."), middle.cast("string")))
    second = _in_place(
        query, _SIZE, F.concat(F.lit("size:"), (middle + 1).cast("string"), F.lit(".."), high.cast("string"))
    )
    return F.when(query.rlike(_SIZE) & (high - low >= NARROWEST_BYTES), F.array(first, second))


def by_language(query: Column) -> Column:
    """The query for each of some languages, and for none of them."""
    each = [F.concat(query, F.lit(f" language:{x}")) for x in K.SPLIT_LANGUAGES]
    rest = F.concat(query, F.lit(" " + " ".join(f"-language:{x}" for x in K.SPLIT_LANGUAGES)))
    return F.array(*each, rest)


def display_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "d MMMM yyyy"), F.lit("—"))


def display_time(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "HH:mm"), F.lit("—"))


def backoff_bound(attempt: Column, base_ms: int, most_ms: int) -> Column:
    """The most that a retry may wait; the wait itself is drawn evenly from 0 to it."""
    return F.least(F.lit(float(most_ms)), base_ms * F.pow(F.lit(2.0), attempt)).cast("long")


def backoff(attempt: Column, base_ms: int, most_ms: int) -> Column:
    return F.floor(F.rand() * (backoff_bound(attempt, base_ms, most_ms) + 1))


def utc(text: str) -> datetime:
    """A time of ISO text; a bare date's first moment."""
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def bisected(start: str, stop: str, count, most: int, depth: int = 10) -> list[tuple[str, str]]:
    """Ranges of time with at most `most` hits by count(start, stop), halved up to `depth` times."""
    low, high = utc(start), utc(stop)
    if depth == 0 or high - low < timedelta(seconds=NARROWEST_SECONDS) or count(start, stop) < most:
        return [(start, stop)]
    middle = (low + (high - low) / 2).replace(microsecond=0)
    iso = lambda t: t.strftime("%Y-%m-%dT%H:%M:%SZ")
    left = bisected(start, iso(middle - timedelta(seconds=1)), count, most, depth - 1)
    return left + bisected(iso(middle), stop, count, most, depth - 1)
