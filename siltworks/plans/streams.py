"""Queries of progress streams, quotas and pacing."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltworks.operators import views
from siltworks.plans.catalog import Tables, query
from siltworks.streaming import progress


def events(t: Tables):
    """Events as progress: a scan is a user, statuses follow the type."""
    status = F.expr("case event_type when 'error' then 'failed' when 'purchase' then 'completed' else 'running' end")
    return t("events").select(
        F.col("user_id").alias("scan_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), "event_id"
    )


STATUS = "case event_type when 'error' then 'failed' when 'purchase' then 'completed' else 'running' end"


@query(
    "daily_budget",
    "O154",
    "select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as used from {events} group by 1, 2",
)
def _(t):
    return progress.daily_budget(t("events"), by="user_id")


@query("pacing_slots", "O153", """
select event_id, max(ms - n * 60000) over (partition by event_type
  order by ms, event_id rows between unbounded preceding and current row) + n * 60000 as slot
from (select event_id, event_type, epoch_us(ts) // 1000 as ms, row_number() over (partition by event_type
  order by epoch_us(ts) // 1000, event_id) as n from {events}) x""")
def _(t):
    return progress.paced(requests(t), 60_000).select("event_id", "slot")


def requests(t: Tables):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return t("events").select(F.col("event_type").alias("scope"), "event_id", ms.alias("ms"))


@query("concurrency", "O155", """
select event_id, cast(sum(case when event_type = 'signup' then 1 else -1 end) over (partition by user_id
  order by event_id rows between unbounded preceding and current row) as bigint) as running
from {events} where event_type in ('signup', 'error')""")
def _(t):
    changes = t("events").where("event_type in ('signup', 'error')").withColumn(
        "delta", F.expr("if(event_type = 'signup', 1, -1)")
    )
    return progress.concurrency(changes, by="user_id", order="event_id").select("event_id", "running")


@query(
    "seq_dedupe",
    "O156",
    f"select user_id as scan_id, event_id as seq, {STATUS} as status from {{events}} where event_id > 100",
)
def _(t):
    e = events(t)
    return progress.after_seq(
        e.union(e.where("seq % 3 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))), 100
    ).select("scan_id", "seq", "status")


@query("throttle_last", "O157", """
select distinct user_id as scan_id, event_id as seq
  from (select *, row_number() over (partition by user_id, time_bucket(interval '1 hour', ts)
  order by ts desc, event_id desc) as rn from {events}) x
where rn = 1 or event_type in ('error', 'purchase')""")
def _(t):
    return progress.throttled(events(t), ms=3_600_000).select("scan_id", "seq")


@query("snapshot_and_live", "O158", """
select user_id as scan_id, count(*) as events
  from (select *, min(case when event_type in ('error', 'purchase')
  then event_id end) over (partition by user_id) as stop from {events}) x where stop is null or event_id <= stop
  group by user_id""")
def _(t):
    e = events(t)
    return progress.merged(e.where("seq < 500"), e.where("seq >= 400")).groupBy("scan_id").agg(
        F.count("*").alias("events")
    )


@query("sticky_status", "O159", f"""
select user_id as scan_id, coalesce(arg_min({STATUS}, event_id) filter (where event_type in ('error', 'purchase')),
  arg_max({STATUS}, event_id)) as status from {{events}} group by user_id""")
def _(t):
    return progress.sticky_status(events(t))


@query("quota_pause", "O161", """
select event_id, coalesce(last_value(case when remaining <= 5 then true when remaining > 20
  then false end ignore nulls) over (partition by event_type
  order by event_id rows between unbounded preceding and current row), false) as paused
from (select event_id, event_type, event_id * 7 % 60 as remaining from {events}) x""")
def _(t):
    rows = t("events").select(
        F.col("event_type").alias("scope"), "event_id", (F.col("event_id") * 7 % 60).alias("remaining")
    )
    return progress.paused(rows).select("event_id", "paused")


@query("quota_status", "O165", """
with l as (select user_id % 3 as ws, event_type as resource, arg_max(event_id * 7 % 60, event_id) as remaining
  from {events} group by 1, 2), u as (select user_id % 3 as ws, count(*) as used from {events} group by 1)
select l.ws, resource, remaining, remaining <= 50 as low, 1000 - used <= 100 as spent from l join u on u.ws = l.ws""")
def _(t):
    e = t("events").select(
        (F.col("user_id") % 3).alias("workspace_id"),
        F.col("event_type").alias("resource"),
        (F.col("event_id") * 7 % 60).alias("remaining"),
        F.col("event_id").alias("at"),
    )
    out = views.quota_status(e, e.groupBy("workspace_id").agg(F.count("*").alias("used")), 1000)
    return out.select(F.col("workspace_id").alias("ws"), "resource", "remaining", "low", "spent")


@query("progress_percent", "O93", """
select event_id, cast(case when event_type = 'signup' then 0 when event_type = 'click' then 5 when event_type = 'view'
  then floor(5 + (event_id % 10) / 10 * 30 + 0.5)
  when event_type = 'error' then least(99, floor((event_id % 40) / 50 * 90 + 5 + 0.5))
    else floor(35 + (event_id % 40) / 50 * 60 + 0.5) end as int) as percent from {events}""")
def _(t):
    phase = F.expr(
        "case event_type when 'signup' then 'queued' when 'click' then 'orchestrating' when 'view' then 'searching' else 'analyzing' end"
    )
    status = F.expr("if(event_type = 'error', 'failed', 'running')")
    done = F.when(F.col("event_type") == "error", F.greatest(F.col("event_id") % 40, F.lit(0))).otherwise(
        F.col("event_id") % 40
    )
    p = progress.percent(status, phase, (F.lit(10), F.col("event_id") % 10), (F.lit(0), F.lit(50), done))
    return t("events").select("event_id", p.alias("percent"))


@query(
    "hourly_counts",
    "extra: event-time windows",
    """
select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, sum(value) as total from {events}
  group by 1, 2""",
)
def _(t):
    return progress.hourly_counts(t("events"))
