"""Queries of routing, schemas, diagrams and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.schema import broken_rules
from tallyloom.operators import diagrams, routing
from tallyloom.operators.findings import clean
from tallyloom.plans.base import Book
from tallyloom.plans.findings import C
from tallyloom.session import ensure_checkpoint_dir
from tallyloom.sources import table
from tallyloom.streaming import telemetry as stream

book = Book()

E = C + """, s as (select rule_id as entry_id, list_sort(list_distinct(flatten(list(string_split(lower(category), '_'))))) as tags, case when max(rank) >= 3 then 'active' else 'draft' end as status, round(avg(rank), 4) as score,
  round(count(*) filter (introduced) / count(*), 6) as history from f group by 1)
"""


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return clean(table(spark, folder, "findings")).groupBy(F.col("rule_id").alias("entry_id")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(F.lower("category"), "_"))))).alias("tags"),
        F.when(F.max("rank") >= 3, "active").otherwise("draft").alias("status"),
        F.round(F.avg("rank"), 4).alias("score"),
        F.round(F.count_if("introduced") / F.count(F.lit(1)), 6).alias("history"),
    )


@book.query(E + "select entry_id, tags, score from s where list_has_any(tags, ['code', 'large']) and status = 'active' and coalesce(nullif(score, 0), -1) >= 0.5")
def f1_registry_query(spark: SparkSession, folder: str) -> DataFrame:
    return routing.registry_query(_entries(spark, folder), ["code", "large"], "active", 0.5).select("entry_id", "tags", "score")


@book.query(E + """, t as (select id as task_id, list_distinct(regexp_extract_all(lower(prompt), '[a-z]+')) as tokens from (select lower(trim(id)) as id, max(prompt) as prompt from evals group by 1)),
x as (select task_id, unnest(tokens) as token from t), n as (select entry_id, len(tags) as n, history, unnest(tags) as token from s),
h as (select task_id, entry_id, round(0.45::double * count(*) / max(n) + 0.10::double * max(history), 6) as score from x join n using (token) group by 1, 2),
b as (select *, max(score) over (partition by task_id) as best from h), k as (select *, row_number() over (partition by task_id order by score desc, entry_id) as place from b where score >= 0.05 and score >= 0.45 * best)
select task_id, entry_id, score, place from k where place <= 3""")
def g7_routes(spark: SparkSession, folder: str) -> DataFrame:
    prompts = table(spark, folder, "evals").groupBy(F.lower(F.trim("id")).alias("task_id")).agg(F.max("prompt").alias("prompt"))
    tasks = prompts.select("task_id", F.regexp_extract_all(F.lower("prompt"), F.lit("[a-z]+"), F.lit(0)).alias("tokens"))
    return routing.routes(tasks, _entries(spark, folder)).select("task_id", "entry_id", "score", F.col("place").cast("long").alias("place"))


@book.query("""select run_id, unnest(list_filter([
  case when mode is null then 'mode: required' end, case when gate is null then 'gate: required' end, case when coalesce(mode not in ('diff', 'full', 'ci'), false) then 'mode: enum' end,
  case when coalesce(duration_ms < 0, false) then 'duration_ms: minimum' end, case when coalesce(cache_hit > 0.9, false) then 'cache_hit: maximum' end,
  case when coalesce(not regexp_matches(run_id, '^[0-9]{8}T[0-9]{6}-[0-9a-f]{8}$'), false) then 'run_id: pattern' end, case when coalesce(len(tool_duration) < 1, false) then 'tool_duration: minItems' end,
  case when coalesce(list_bool_or(list_transform(tool_duration, lambda x: coalesce(x.provider is not null and length(x.provider) < 3, false))), false) then 'tool_duration: items' end], lambda x: x is not null)) as broken from run_ledgers""".replace("case when coalesce(list_bool_or(list_transform(tool_duration, lambda x: coalesce(x.provider is not null and length(x.provider) < 3, false))), false) then 'tool_duration: items' end", "case when coalesce(llm_calls <= 0, false) then 'llm_calls: exclusiveMinimum' end"))
def f14_schema_rules(spark: SparkSession, folder: str) -> DataFrame:
    schema = {
        "required": ["mode", "gate"],
        "properties": {
            "mode": {"enum": ["diff", "full", "ci"]},
            "duration_ms": {"minimum": 0},
            "cache_hit": {"maximum": 0.9},
            "run_id": {"pattern": "^[0-9]{8}T[0-9]{6}-[0-9a-f]{8}$"},
            "tool_duration": {"minItems": 1},
            "llm_calls": {"exclusiveMinimum": 0},
        },
    }
    return table(spark, folder, "run_ledgers").select("run_id", F.explode(broken_rules(schema)).alias("broken"))


def _flows(spark: SparkSession, folder: str) -> DataFrame:
    """A diagram for each repo: its runs' providers in order of the run."""
    timings = table(spark, folder, "tool_timings").where("provider is not null").select("repo", F.regexp_replace(F.lower(F.trim("provider")), "-", "_").alias("p")).distinct()
    lines = timings.groupBy("repo").agg(F.array_sort(F.collect_set("p")).alias("p"))
    edges = F.transform(F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))), lambda i: F.concat(F.coalesce(F.try_element_at("p", i - 1), F.lit("lone")), F.lit(" --> "), F.coalesce(F.try_element_at("p", i), F.lit("lone"))))
    return lines.select("repo", F.concat(F.lit("flowchart LR\n"), F.array_join(edges, "\n"), F.lit("\norphan[Nobody calls me]\n")).alias("dsl"))


@book.query("select distinct repo as key, 'orphan' as id from tool_timings where provider is not null")
def j12_isolated_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return diagrams.isolated(diagrams.read_flows(_flows(spark, folder), "repo", "dsl"))


#: A figure for each repo whose providers form a chain; what it breaks follows from their number and from the repo's name.
_FIGURES = """with n as (select repo as key, list_sort(list_distinct(list(replace(lower(trim(provider)), '-', '_')))) as p from tool_timings where provider is not null and repo is not null group by 1),
g as (select *, len(p) as n, length(key) % 2 = 0 as lr, length(key) % 3 = 0 as bare from n)
"""


def _figures(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "tool_timings").where("provider is not null and repo is not null").select("repo", F.regexp_replace(F.lower(F.trim("provider")), "-", "_").alias("p")).distinct()
    lines = names.groupBy("repo").agg(F.array_sort(F.collect_set("p")).alias("p"))
    head = F.when(F.length("repo") % 3 == 0, "flowchart").when(F.length("repo") % 2 == 0, "flowchart LR").otherwise("flowchart TD")
    chain = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.concat(F.lit("n"), i.cast("string"), F.lit('["'), F.element_at("p", i), F.lit('"] --> n'), (i + 1).cast("string")))
    more = F.lit("\nsubgraph s1\n a1\n end\n a1 --> n1\n end[Stop (now)]\n 支付 ~~~ n1\n lone[A label of more than twenty-six signs]\n t1[<u>x</u> <br/>] --> n1\n c1[see FooBar.java] --> n1\n c2[readLedgerNow] --> n1\n")
    return lines.select("repo", F.concat(head, F.lit("\n"), F.array_join(chain, "\n"), more).alias("dsl"))


@book.query(_FIGURES + """, r as (select key, unnest(['P07', 'P14', 'P06', 'P13', 'P08', 'P04', 'P05', 'P11', 'P12', 'P08',
    case when bare then 'P01' end, case when not bare and lr and n + 2 > 7 then 'P09' end, case when (bare or not lr) and n + 2 >= 8 then 'P10' end, case when n + 8 > 12 then 'P02' end, case when n + 4 > 14 then 'P03' end]) as rule, n from g)
select key, rule, count(*) as times, max(n + 2)::int as layers from r where rule is not null group by 1, 2""")
def v13_diagram_lint(spark: SparkSession, folder: str) -> DataFrame:
    """How often every figure breaks each rule, and its number of layers."""
    return diagrams.lint(_figures(spark, folder), "repo", "dsl").groupBy("key", "rule").agg(F.count(F.lit(1)).alias("times"), F.max("layers").alias("layers"))


@book.query("""with p as (select distinct lower(trim(provider)) as name from tool_timings where provider is not null), d as (select provider as name from providers where provider <> 'pmd' union select 'gone')
select coalesce(p.name, d.name) as name, case when d.name is null then 'drift' else 'stale' end as side from p full outer join d using (name) where p.name is null or d.name is null""")
def j9_drift(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "tool_timings").where("provider is not null").select(F.lower(F.trim("provider")).alias("name")).distinct()
    known = table(spark, folder, "providers").where("provider != 'pmd'").select(F.col("provider").alias("name")).unionByName(spark.range(1).select(F.lit("gone").alias("name")))
    return diagrams.drift(used, known, "name")


@book.query("select date_trunc('day', ts) as start, event_type, count(*) as calls, count(*) filter (event_type <> 'error') as succeeded from events group by 1, 2")
def x2_streamed_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The event log read as a stream until it is used up; an extension beside the batch summary."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/rates-{uuid.uuid4().hex}"
    return stream.run_to_files(stream.windowed_rates(stream.read_events(spark, folder)), f"{at}/result", f"{at}/state")


QUERIES, SQL = book.queries, book.sql
