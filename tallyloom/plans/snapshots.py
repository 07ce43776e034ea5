"""Query of the snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.snapshots import changes
from tallyloom.sources import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return changes(table(spark, folder, "baseline_metrics")).select(
        "repo", F.col("snapshot_no").cast("int").alias("snapshot_no"), "rule_id", "file", F.col("start_line").cast("int").alias("start_line"), "symbol", "change_kind"
    )


P2_SQL = r"""
with ranked as (
  select *, row_number() over (partition by repo, snapshot_no order by received_at desc, len(findings) desc) as rn
  from baseline_metrics where repo is not null and snapshot_no is not null),
latest as (select repo, snapshot_no, findings, entries from ranked where rn = 1),
ordered as (select repo, snapshot_no, lag(snapshot_no) over (partition by repo order by snapshot_no) as prev_no from latest),
k as (
  select distinct repo, snapshot_no, trim(json_extract_string(j, '$.rule_id')) as rule_id,
    regexp_replace(regexp_replace(trim(json_extract_string(j, '$.file')), '[\\/]+', '/', 'g'), '^(\./)+', '') as file,
    cast(json_extract_string(j, '$.line') as int) as start_line,
    coalesce(trim(json_extract_string(j, '$.symbol')), '') as symbol
  from (select repo, snapshot_no, unnest(findings) as j from latest)),
en as (
  select repo, snapshot_no, trim(e.rule_id) as rule_id,
    regexp_replace(regexp_replace(trim(e.file), '[\\/]+', '/', 'g'), '^(\./)+', '') as file,
    e.start_line as start_line, coalesce(trim(e.symbol), '') as symbol,
    max(concat_ws('|', lower(trim(e.category)), lower(trim(e.severity)), round(e.confidence, 4), lower(trim(e.status)),
      lower(trim(regexp_replace(e.title, '\s+', ' ', 'g'))), e.end_line,
      array_to_string(list_sort(list_distinct(list_transform(e.sources, lambda x: lower(trim(x))))), ','))) as state
  from (select repo, snapshot_no, unnest(entries) as e from latest) group by all),
r as (
  select k.*, en.state from k left join en using (repo, snapshot_no, rule_id, file, start_line, symbol)),
cur as (select r.*, o.prev_no from r join ordered o using (repo, snapshot_no) where o.prev_no is not null),
prev as (select r.repo, o.snapshot_no, r.rule_id, r.file, r.start_line, r.symbol, r.state from r join ordered o on r.repo = o.repo and r.snapshot_no = o.prev_no)
select coalesce(c.repo, p.repo) as repo, coalesce(c.snapshot_no, p.snapshot_no) as snapshot_no, coalesce(c.rule_id, p.rule_id) as rule_id,
  coalesce(c.file, p.file) as file, coalesce(c.start_line, p.start_line) as start_line, coalesce(c.symbol, p.symbol) as symbol,
  case when p.repo is null then 'added' when c.repo is null then 'removed' else 'changed' end as change_kind
from cur c full outer join prev p on c.repo = p.repo and c.snapshot_no = p.snapshot_no and c.rule_id = p.rule_id and c.file = p.file
  and c.start_line = p.start_line and c.symbol = p.symbol
where p.repo is null or c.repo is null or c.state <> p.state
"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
