"""Queries of the percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.percentiles import latest_rows, merge, percentiles, provider_name, value_counts
from tallyloom.session import cut
from tallyloom.sources import table

GROUP = ["source", "kind", "grp"]
#: Relative error of the daily digests.
DIGEST_ERROR = 0.01


def _timings(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "tool_timings").select("timing_id", "provider", "duration_ms", "recorded_at", "received_at")
    rows = rows.withColumn("provider", provider_name("provider"))
    latest = latest_rows(rows, "timing_id", "received_at", ["provider", "duration_ms", "recorded_at"])
    return latest.select(
        F.lit("tool_timings").alias("source"), F.lit("provider").alias("kind"), F.col("provider").alias("grp"), "duration_ms", F.to_date("recorded_at").alias("day")
    )


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by repo and by mode: each run stands in two groups."""
    rows = table(spark, folder, "run_ledgers").select("run_id", "repo", F.lower(F.trim("mode")).alias("mode"), "duration_ms", "started_at", "received_at")
    latest = latest_rows(rows, "run_id", "received_at", ["repo", "mode", "duration_ms", "started_at"])
    groups = F.array(
        F.struct(F.lit("repo").alias("kind"), F.col("repo").alias("grp")),
        F.struct(F.lit("mode").alias("kind"), F.col("mode").alias("grp")),
    )
    return latest.select(F.lit("run_ledgers").alias("source"), F.explode(groups).alias("g"), "duration_ms", F.to_date("started_at").alias("day")).select(
        "source", "g.kind", "g.grp", "duration_ms", "day"
    )


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact percentiles of tool durations by provider and of run durations by repo and mode."""
    counts = [value_counts(rows, GROUP, "duration_ms") for rows in (_timings(spark, folder), _runs(spark, folder))]
    return percentiles(cut(merge(GROUP, *counts)), GROUP)


def p4_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Daily digests with one per cent error, the form to keep and combine."""
    keys = [*GROUP, "day"]
    parts = [value_counts(rows, keys, "duration_ms", DIGEST_ERROR) for rows in (_timings(spark, folder), _runs(spark, folder))]
    return parts[0].unionByName(parts[1])


def p4_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles over all days, from the daily digests alone."""
    return percentiles(cut(merge(GROUP, p4_digest(spark, folder))), GROUP)


P4_SQL = """
with t as (
  select * from (select *, row_number() over (partition by timing_id order by received_at desc, duration_ms desc) as rn from tool_timings where timing_id is not null) where rn = 1),
r as (
  select * from (select *, row_number() over (partition by run_id order by received_at desc, duration_ms desc) as rn from run_ledgers where run_id is not null) where rn = 1),
v as (
  select 'tool_timings' as source, 'provider' as kind, nullif(regexp_replace(lower(trim(regexp_replace(provider, '\\s*:.*$', ''))), '[\\s_]+', '-', 'g'), '') as grp, duration_ms from t
  union all select 'run_ledgers', 'repo', repo, duration_ms from r
  union all select 'run_ledgers', 'mode', lower(trim(mode)), duration_ms from r),
k as (
  select source, kind, grp, duration_ms, row_number() over (partition by source, kind, grp order by duration_ms) as i, count(*) over (partition by source, kind, grp) as n
  from v where duration_ms >= 0)
select source, kind, grp, max(n) as n,
  min(duration_ms) filter (i >= ceil(n * 0.5)) as p50, min(duration_ms) filter (i >= ceil(n * 0.9)) as p90,
  min(duration_ms) filter (i >= ceil(n * 0.95)) as p95, min(duration_ms) filter (i >= ceil(n * 0.99)) as p99
from k group by source, kind, grp
"""

#: The grid of the digests: values up to 1 / error as they are, above rounded down to a power of 1 + error.
DIGEST_SQL = P4_SQL.split("k as (")[0].replace("duration_ms from t", "duration_ms, recorded_at::date as day from t").replace("repo, duration_ms from r", "repo, duration_ms, started_at::date from r").replace("lower(trim(mode)), duration_ms from r", "lower(trim(mode)), duration_ms, started_at::date from r") + """
d as (
  select source, kind, grp, day, case when duration_ms <= 100 then duration_ms
    else least(duration_ms, ceil(exp(floor(ln(duration_ms) / ln(1.01::double) + 1e-9::double) * ln(1.01::double)) - 1e-6::double)::bigint) end as value, count(*) as n
  from v where duration_ms >= 0 group by all)
"""
MERGED_SQL = DIGEST_SQL + """, m as (select source, kind, grp, value, sum(n)::bigint as n from d group by all),
k as (select *, sum(n) over (partition by source, kind, grp order by value) as upto, sum(n) over (partition by source, kind, grp) as whole from m)
select source, kind, grp, max(whole)::bigint as n, min(value) filter (upto >= ceil(whole * 0.5)) as p50, min(value) filter (upto >= ceil(whole * 0.9)) as p90,
  min(value) filter (upto >= ceil(whole * 0.95)) as p95, min(value) filter (upto >= ceil(whole * 0.99)) as p99
from k group by source, kind, grp
"""

QUERIES = {"p4_percentiles": p4_percentiles, "p4_digest": p4_digest, "p4_merged": p4_merged}
SQL = {"p4_percentiles": P4_SQL, "p4_digest": DIGEST_SQL + "select * from d", "p4_merged": MERGED_SQL}
