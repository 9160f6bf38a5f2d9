"""Quotas over the event table, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.session import shared_folder
from quillgrid.streaming.quota import admit_events, admit_stream, minute_counts, minute_quota
from quillgrid.streaming.windows import event_windows, joint_quota

from .base import load, query

_LIMIT, _WINDOW = 3, 600_000


def _events(spark, sf):
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")


def _event_stream(spark, sf):
    # A few files a micro-batch, so that what waits is bounded by the lateness.
    return spark.readStream.schema(load(spark, sf, "events").schema).option("maxFilesPerTrigger", 8).parquet(f"{sf}/events*.parquet")


def _run_to_end(spark, stream):
    """Everything the source has now, through a file sink in the shared folder."""
    folder = shared_folder(spark)
    out = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
    out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _log_sql(keys, limit, window):
    """Every key's events one after another, each with the admitted times still in the window."""
    same = " and ".join(f"e.{k} = s.{k}" for k in keys)
    return f"""
    with recursive e as (
      select event_id, user_id, event_type, epoch_us(ts) // 1000 as ms, row_number() over (partition by {", ".join(keys)} order by epoch_us(ts) // 1000, event_id) as place from events),
    s as (
      select *, []::bigint[] as recent from e where place = 1 union all
      select e.*, list_filter(case when len(s.recent) < {limit} then list_append(s.recent, s.ms) else s.recent end, lambda x: e.ms - x < {window})
      from s join e on {same} and e.place = s.place + 1)
    select event_id, user_id, event_type, len(recent) < {limit} as admitted, greatest(0, {limit} - 1 - len(recent))::int as remaining,
           case when len(recent) < {limit} then 0 else greatest(1, ceil(({window} - (ms - recent[1])) / 1000)) end::int as retry_after_seconds
    from s
    """


@query("admission_log", _log_sql(["event_type"], _LIMIT, _WINDOW))
def admission_log(spark, sf):
    """Three events per ten minutes and event type."""
    return admit_events(_events(spark, sf), ["event_type"], "ts", _LIMIT, _WINDOW, "event_id").drop("ts")


@query("admission_log_per_user", _log_sql(["user_id", "event_type"], 1, 3_600_000))
def admission_log_per_user(spark, sf):
    return admit_events(_events(spark, sf), ["user_id", "event_type"], "ts", 1, 3_600_000, "event_id").drop("ts")


@query("admission_stream", _log_sql(["event_type"], _LIMIT, _WINDOW) + " where ms < (select max(ms) - 60000 from e)")
def admission_stream(spark, sf):
    """Events that the watermark has passed when the stream ends."""
    # What waits in the store has the columns that are asked for.
    given = _event_stream(spark, sf).select("event_id", "user_id", "event_type", "ts")
    stream = admit_stream(given, ["event_type"], "ts", _LIMIT, _WINDOW, tie="event_id")
    return _run_to_end(spark, stream).where("not late").select("event_id", "user_id", "event_type", "admitted", "remaining", "retry_after_seconds")


@query(
    "exact_windows",
    f"""
    with recursive e as (select event_type, epoch_us(ts) // 1000 as ms from events),
    s as (
      select event_type, min(ms) as window_start from e group by 1 union all
      select s.event_type, (select min(ms) from e where e.event_type = s.event_type and ms >= s.window_start + {_WINDOW}) from s where s.window_start is not null)
    select s.event_type, s.window_start, count(*) as n
    from s join e on e.event_type = s.event_type and e.ms >= s.window_start and e.ms < s.window_start + {_WINDOW} group by 1, 2
    """,
)
def exact_windows(spark, sf):
    """Ten-minute windows from a type's first event on."""
    return event_windows(_events(spark, sf), ["event_type"], "ts", _WINDOW)


_HALF_HOUR, _ALL, _ACTOR, _ACTIONS = 1_800_000, 5, 1, {"click": 2, "view": 1, "purchase": 1, "error": 1}
_CAP = "case event_type " + " ".join(f"when '{a}' then {n}" for a, n in _ACTIONS.items()) + " end"


@query(
    "joint_quota",
    f"""
    with recursive e as (
      select event_id, user_id::varchar as actor, event_type as action, {_CAP} as cap, epoch_us(ts) // 1000 as ms from events where {_CAP} is not null),
    o as (select *, row_number() over (order by ms, event_id) as place, ms - lag(ms) over (order by ms, event_id) as gap from e),
    r as (select *, sum(case when gap < {_HALF_HOUR} then 0 else 1 end) over (order by place) as run from o),
    p as (select *, row_number() over (partition by run order by place) as step from r),
    k as (select *, [{{'key': '*', 'scope': 'global', 'cap': {_ALL}}}, {{'key': 'a' || actor, 'scope': 'actor', 'cap': {_ACTOR}}},
                     {{'key': 'b' || actor || ':' || action, 'scope': 'actor_action', 'cap': cap}}] as keys from p),
    s as (
      select run, step, event_id, ms, keys, []::struct(key varchar, start bigint, n bigint)[] as held, keys[1:0] as hit from k where step = 1 union all
      select run, step, event_id, ms, keys, held, list_filter(keys, lambda q: len(list_filter(held, lambda w: w.key = q.key and w.n >= q.cap)) > 0) from (
        select k.run, k.step, k.event_id, k.ms, k.keys,
          list_filter(case when len(s.hit) > 0 then s.held else list_concat(
              list_transform(s.held, lambda w: {{'key': w.key, 'start': w.start, 'n': w.n + len(list_filter(s.keys, lambda q: q.key = w.key))}}),
              list_transform(list_filter(s.keys, lambda q: len(list_filter(s.held, lambda w: w.key = q.key)) = 0), lambda q: {{'key': q.key, 'start': s.ms, 'n': 1}})) end,
            lambda w: k.ms - w.start < {_HALF_HOUR}) as held
        from s join k on k.run = s.run and k.step = s.step + 1))
    select event_id, len(hit) = 0 as allowed, hit[1].scope as scope,
      case when len(hit) = 0 then 0 else greatest(1, ceil((list_filter(held, lambda w: w.key = hit[1].key)[1].start + {_HALF_HOUR} - ms) / 1000)) end::bigint as retry_after_seconds
    from s
    union all select event_id, false, 'invalid', null from events where {_CAP} is null
    """,
)
def quota_of_three_keys(spark, sf):
    """Five events per half hour for all, one per user, and so many per user and type."""
    out = joint_quota(_events(spark, sf), "user_id", "event_type", "ts", "event_id", _HALF_HOUR, _ALL, _ACTOR, _ACTIONS)
    return out.select("event_id", "allowed", "scope", "retry_after_seconds")


_FINE = "(select date_trunc('minute', ts) as minute, user_id::varchar as actor, event_type as action, count(*) as n from events group by 1, 2, 3)"


@query(
    "minute_quota",
    f"""
    with fine as {_FINE}, scoped as (
      select minute, 'global' as scope, null::varchar as actor, null::varchar as action, sum(n)::bigint as n from fine group by 1 union all
      select minute, 'actor', actor, null, sum(n)::bigint from fine group by 1, 3 union all
      select minute, 'actor_action', actor, action, n from fine)
    select strftime(minute, '%Y-%m-%d %H:%M') as minute, scope, actor, action, n,
           case scope when 'global' then 120 when 'actor' then 30 else case action when 'click' then 1 when 'view' then 2 end end as "limit",
           coalesce(n > case scope when 'global' then 120 when 'actor' then 30 else case action when 'click' then 1 when 'view' then 2 end end, false) as over_limit
    from scoped
    """,
)
def quota(spark, sf):
    out = minute_quota(_events(spark, sf), "user_id", "event_type", "ts", {"click": 1, "view": 2})
    return out.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query(
    "minute_counts_stream",
    f"""
    select strftime(minute, '%Y-%m-%d %H:%M') as minute, actor, action, n from {_FINE}
    where minute + interval 1 minute <= (select max(ts) - interval 1 minute from events)
    """,
)
def counts_stream(spark, sf):
    """Minutes the watermark has passed when the stream ends."""
    stream = minute_counts(_event_stream(spark, sf), "user_id", "event_type", "ts", "1 minute")
    return _run_to_end(spark, stream).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))
