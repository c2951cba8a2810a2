"""Streams run to their end, held against the same results in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.plans.fixtures import busy, oracle
from quaymark.plans.registry import Registry
from quaymark.plans.sequence_queries import R as BATCH
from quaymark.sources.tables import load
from quaymark.streaming import jobs

R = Registry()


def events(s: SparkSession, d: str) -> DataFrame:
    return jobs.read_stream(s, d, load(s, d, "events"), pattern="events*.parquet" if not d.endswith("/events.parquet") else "*.parquet")


def calls(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).selectExpr("user_id as session_key", "event_id as call_id", "cast(ts as timestamp) as ts", "concat(event_type, ':', cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 3 as string)) as sig", "event_type = 'error' as is_error")


_REPEAT = oracle(", l as (select *, list(sig) over (partition by session_key order by ts, call_id rows between 9 preceding and current row) as sigs from busy), m as (select session_key, call_id, list_max(list_transform(list_distinct(sigs), lambda s: len(list_filter(sigs, lambda x: x = s)))) as most from l) select session_key, call_id, cast(most as bigint) as most from m where most >= 5", "busy")
R.add("stream_loop_repeat", lambda s, d: jobs.run_once(jobs.repeated_calls(busy(events(s, d)))), _REPEAT)
R.add("stream_no_progress", lambda s, d: jobs.run_once(jobs.no_progress(busy(events(s, d)))), BATCH.oracles["no_progress"])
R.add("stream_error_streak", lambda s, d: jobs.run_once(jobs.error_streaks(calls(s, d), 3)), oracle(", m as (select *, case when lag(is_error) over (partition by session_key order by ts, call_id) = is_error then 0 else 1 end as n from calls), g as (select *, sum(n) over (partition by session_key order by ts, call_id) as g from m), r as (select session_key, call_id, is_error, row_number() over (partition by session_key, g order by ts, call_id) as streak from g) select session_key, call_id, streak from r where is_error and streak = 3", "calls"))
# every event is delivered twice
R.add("late_data", lambda s, d: jobs.run_once(jobs.drop_redelivered(events(s, d).unionAll(events(s, d)), ["event_id"])).select("event_id", "event_type"), "select distinct event_id, event_type from (select * from events union all select * from events)")
# all windows and sessions that the watermark has closed, whatever the dates of the data
R.add("stream_tumbling", lambda s, d: jobs.run_once(jobs.windowed(events(s, d), "user_id", "6 hours")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "total"), "select strftime(time_bucket(interval 6 hours, ts, timestamp '2000-01-01'), '%Y-%m-%d %H:%M:%S') as start, count(*) as n, cast(sum(user_id) as bigint) as total from events where time_bucket(interval 6 hours, ts, timestamp '2000-01-01') + interval 6 hours <= (select max(ts) from events) - interval 1 hour group by 1")
R.add("stream_session", lambda s, d: jobs.run_once(jobs.session_totals(events(s, d), "user_id", "12 hours")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), "with l as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 43200000000 then 0 else 1 end as b from events window w as (partition by user_id order by ts)), g as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as g from l), x as (select user_id, g, min(ts) as st, max(ts) as en, count(*) as n from g group by 1, 2) select user_id, strftime(st, '%Y-%m-%d %H:%M:%S') as start, n from x where en + interval 12 hours <= (select max(ts) from events) - interval 1 hour")
