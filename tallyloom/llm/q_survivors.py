"""Queries of the best representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.survivors import source_quality, survivors, true_values
from tallyloom.sources import table


def _inputs(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, name) for name in ("findings", "merge_groups", "providers")]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors(*_inputs(spark, folder)).select("group_key", "field_name", "finding_id")


def p6_values(spark: SparkSession, folder: str) -> DataFrame:
    """All values judged true."""
    return true_values(*_inputs(spark, folder))


def p6_sources(spark: SparkSession, folder: str) -> DataFrame:
    return source_quality(*_inputs(spark, folder))


P6_SQL = r"""
with recursive rows as (select kept_id, unnest(list_append(merged_ids, kept_id)) as id from merge_groups),
known as (select distinct kept_id, id from rows where id in (select id from findings)),
hops as (select distinct a.id as x, b.id as y from known a join known b using (kept_id)),
reach as (select id as x, id as y from (select distinct id from known) union select r.x, h.y from reach r join hops h on r.y = h.x),
member as (select x as id, min(y) as group_key from reach group by x),
last as (select * from (select *, row_number() over (partition by id order by received_at desc) as rn from findings) where rn = 1),
rank as (
  select id, min(p.trust_rank) as trust
  from (select id, regexp_replace(lower(trim(regexp_replace(unnest(sources), '\s*:.*$', ''))), '[\s_]+', '-', 'g') as provider from last) join providers p using (provider) group by id),
cells as (
  select id, reported_at, 'title' as field_name from last where lower(trim(title)) not in ('', '-', '?', 'n/a', 'none', 'null', 'tbd', 'unknown', '<none>')
  union all select id, reported_at, 'symbol' from last where lower(trim(symbol)) not in ('', '-', '?', 'n/a', 'none', 'null', 'tbd', 'unknown', '<none>')
  union all select id, reported_at, 'severity' from last where upper(trim(severity)) in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')
  union all select id, reported_at, 'perf_confidence' from last where upper(trim(perf_confidence)) in ('SUSPECTED', 'LIKELY', 'PROVEN')
  union all select id, reported_at, 'confidence' from last where confidence between 0 and 1
  union all select id, reported_at, 'end_line' from last where end_line >= start_line)
select group_key, field_name, id as finding_id from (
  select group_key, field_name, id, row_number() over (partition by group_key, field_name order by coalesce(trust, 2147483647), reported_at desc, id) as rn
  from cells join member using (id) left join rank using (id))
where rn = 1
"""

QUERIES = {"p6_found": p6_found, "p6_values": p6_values, "p6_sources": p6_sources}
SQL = {"p6_found": P6_SQL}
