"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import telemetry as ops
from tallyloom.plans.base import Book
from tallyloom.sources import table

book = Book()
T = """with t as (
  select event_id as line, ts, user_id || '-' || strftime(ts, '%Y%m%d') as session_id, cast(user_id % 4 as varchar) as agent_id, event_type as skill_id,
    cast(json_extract_string(props, '$.k') as bigint) % 10 as tool_id, event_type <> 'error' as success, cast(floor(value * 10) as bigint) as latency_ms,
    cast(json_extract_string(props, '$.k') as bigint) % 3 = 0 as cache_hit,
    not (event_type = 'error' and cast(json_extract_string(props, '$.k') as bigint) % 50 = 0) as evidence_kept, cast(json_extract_string(props, '$.k') as bigint) as tokens, cast(json_extract_string(props, '$.k') as bigint) % 6 + 1 as calls
  from events),
s as (select count(*) as events, count(*) filter (success) as succeeded, round(count(*) filter (success) / count(*), 6) as success_rate, cast(sum(tokens) as bigint) as tokens,
    round(count(*) filter (cache_hit) / count(*), 6) as cache_hit_rate, round(avg(latency_ms), 6) as avg_latency_ms, count(*) filter (not evidence_kept) as evidence_lost, round(avg(calls), 6) as calls_per_event from t),
r as (select *, row_number() over (partition by session_id, agent_id, skill_id, tool_id order by line) as nth from t)
"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return ops.typed(table(spark, folder, "events"))


@book.query(T + "select * from s")
def a10_telemetry_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ops.summary(_events(spark, folder))


@book.query(T + """select agent_id, skill_id, cast(grouping(agent_id) * 2 + grouping(skill_id) as int) as level, count(*) as events, round(count(*) filter (success) / count(*), 6) as success_rate
from t group by grouping sets ((agent_id), (skill_id), (agent_id, skill_id))""")
def a11_group_success(spark: SparkSession, folder: str) -> DataFrame:
    return ops.group_rates(_events(spark, folder))


SCAN = """select sum(case when ok then 1 else 0 end)::bigint as parsed, sum(case when not ok and length(trim(line)) > 0 then 1 else 0 end)::bigint as malformed, sum(case when length(trim(line)) = 0 then 1 else 0 end)::bigint as blank
from (select line, json_valid(line) and json_type(case when json_valid(line) then line else 'null' end) = 'OBJECT' as ok
  from (select case event_id % 7 when 0 then substr(props, 1, length(props) - 1) when 1 then '[1]' when 2 then '  ' else props end as line from events))"""


@book.query(SCAN)
def s8_jsonl_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an event log: objects, malformed or non-object lines, blank lines."""
    line = F.expr("case event_id % 7 when 0 then substr(props, 1, length(props) - 1) when 1 then '[1]' when 2 then '  ' else props end")
    lines = table(spark, folder, "events").select(line.alias("line"))
    parsed = F.from_json("line", "k bigint, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    blank = F.length(F.trim("line")) == 0
    ok = ~blank & parsed["_corrupt"].isNull() & F.trim("line").startswith("{")
    return lines.agg(F.count_if(ok).alias("parsed"), F.count_if(~ok & ~blank).alias("malformed"), F.count_if(blank).alias("blank"))


@book.query(T + f", m as ({SCAN})" + """, c as (select s.*, (select count(*) from r where nth > 1) as repeats, (select malformed from m) as malformed from s)
select * from (
  select 'LOW_SUCCESS' as code, success_rate as value, 0.9::double as threshold from c where events >= 5 and success_rate < 0.9
  union all select 'LOW_CACHE_HIT', cache_hit_rate, 0.5 from c where events >= 5 and cache_hit_rate < 0.5
  union all select 'HIGH_LATENCY', avg_latency_ms, 500.0 from c where avg_latency_ms > 500
  union all select 'EVIDENCE_LOST', evidence_lost::double, 0.0 from c where evidence_lost > 0
  union all select 'RETRY_STORM', calls_per_event, 3.0 from c where calls_per_event > 3
  union all select 'MALFORMED_LINES', malformed::double, 0.0 from c where malformed > 0
  union all select 'REPEATED_CALLS', round(repeats / events, 6), 0.2 from c where events >= 5 and repeats / events > 0.2)""")
def a12_alerts(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(spark, folder)
    return ops.alerts(ops.summary(events), ops.repeats(events), s8_jsonl_scan(spark, folder))


@book.query(T + "select line, session_id, agent_id, skill_id, tool_id, nth from r where nth > 1")
def w1_repeated_calls(spark: SparkSession, folder: str) -> DataFrame:
    return ops.repeats(_events(spark, folder)).select("line", "session_id", "agent_id", "skill_id", "tool_id", F.col("nth").cast("long").alias("nth"))


@book.query(T + "select skill_id as error_class, count(*) as n from t where not success group by 1")
def a10_error_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).where("not success").groupBy(F.col("skill_id").alias("error_class")).agg(F.count(F.lit(1)).alias("n"))


@book.query(T + """, d as (select skill_id, date_trunc('day', ts) as day, count(*) as n, max(line) as last_line from t group by 1, 2)
select skill_id, strftime(day, '%Y-%m-%d') as day, n, last_line, cast(sum(n) over (partition by skill_id order by day) as bigint) as running,
  n - coalesce(lag(n) over (partition by skill_id order by day), 0) as delta from d""")
def w9_daily_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered trend by skill and day with running total and change; reduced to days before any window."""
    from pyspark.sql import Window

    days = _events(spark, folder).groupBy("skill_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last_line"))
    w = Window.partitionBy("skill_id").orderBy("day")
    return days.withColumn("running", F.sum("n").over(w)).withColumn("delta", F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0)))


QUERIES, SQL = book.queries, book.sql
