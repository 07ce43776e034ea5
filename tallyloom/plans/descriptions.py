"""Queries of descriptions and of whole routes. Descriptions are made from the findings' rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import descriptions as fx
from tallyloom.functions.text import squeeze, tokens
from tallyloom.operators import routing
from tallyloom.operators.joins import with_replacement
from tallyloom.plans.base import Book
from tallyloom.sources import table

book = Book()
#: Hints of the kinds of a task, in order.
HINTS = (("database", ("sql", "table", "column", "库")), ("performance", ("slow", "slowly", "慢", "peak")), ("dead_code", ("using", "delete", "删")), ("over_engineering", ("explain", "用大白话", "explique")))
STOP = ", ".join(f"'{w}'" for w in fx.STOP_WORDS)
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
#: One description and body for each rule.
D = r"""with e0 as (select rule_id as entry_id, min(upper(trim(category))) as category, count(*) as n, max(case upper(trim(severity)) when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 when 'CRITICAL' then 3 end) as worst from findings where rule_id is not null and category is not null group by 1),
e as (select *, lower(replace(category, '_', ' ')) as words, 'Finds ' || lower(replace(category, '_', ' ')) || ' in the audit worker, 检查代码 /ai-' || lower(entry_id) || ' src/x. Not for release ' || lower(replace(category, '_', '-')) || ' plans, and /ai-doc alone; 发布计划' as description,
  'trig: ' || lower(replace(category, '_', ' ')) || ' | report，snapshot writer prio: 3' || chr(10) || 'other: x' as body from e0)
"""


def _described(spark: SparkSession, folder: str) -> DataFrame:
    rank = F.when(F.upper(F.trim("severity")) == "LOW", 0).when(F.upper(F.trim("severity")) == "MEDIUM", 1).when(F.upper(F.trim("severity")) == "HIGH", 2).when(F.upper(F.trim("severity")) == "CRITICAL", 3)
    rows = table(spark, folder, "findings").where("rule_id is not null and category is not null").groupBy(F.col("rule_id").alias("entry_id")).agg(F.min(F.upper(F.trim("category"))).alias("category"), F.count(F.lit(1)).alias("n"), F.max(rank).alias("worst"))
    words = F.lower(F.replace("category", F.lit("_"), F.lit(" ")))
    description = F.concat(F.lit("Finds "), words, F.lit(" in the audit worker, 检查代码 /ai-"), F.lower("entry_id"), F.lit(" src/x. Not for release "), F.lower(F.replace("category", F.lit("_"), F.lit("-"))), F.lit(" plans, and /ai-doc alone; 发布计划"))
    body = F.concat(F.lit("trig: "), words, F.lit(" | report，snapshot writer prio: 3\nother: x"))
    return rows.withColumn("words", words).withColumn("description", description).withColumn("body", body)


_POSITIVE, _NEGATIVE = "regexp_extract(description, '^(.*?)(?:Not for|不用于)', 1, 's')", "regexp_extract(description, '^.*?Not for(.*)$', 1, 's')"


@book.query(D + f"select entry_id, {_POSITIVE} as positive, {_NEGATIVE} as negative from e")
def t7_clauses(spark: SparkSession, folder: str) -> DataFrame:
    return _described(spark, folder).select("entry_id", fx.positive_clause(F.col("description")).alias("positive"), fx.negative_clause(F.col("description")).alias("negative"))


@book.query(D + f"select entry_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({_POSITIVE}, '[A-Za-z][A-Za-z0-9_\\-]{{2,}}'), lambda w: lower(regexp_replace(w, '[_\\-]+$', ''))), lambda w: length(w) >= 3 and w not in ({STOP})))) as tags from e")
def t6_derived_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _described(spark, folder).select("entry_id", fx.derived_tags(F.col("description")).alias("tags"))


@book.query(f"""select doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_\\-]{{3,}}'), lambda w: lower(regexp_replace(w, '[_\\-]+$', ''))), lambda w: length(w) >= 4 and w not in ({STOP}))
  || coalesce(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '{CJK}{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))), []))) as keywords from documents""")
def t5_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", fx.keywords(F.col("text")).alias("keywords"))


@book.query(D + "select entry_id, [words, 'report', 'snapshot writer', '/ai-' || lower(entry_id), '检查代码'] as found, ['/ai-doc', 'release ' || lower(replace(category, '_', '-')) || ' plans', '发布计划'] as excluded from (select * from e where length('release ' || replace(category, '_', '-') || ' plans') <= 32) where true")
def t8_triggers(spark: SparkSession, folder: str) -> DataFrame:
    rows = _described(spark, folder).where(F.length(F.concat(F.lit("release "), F.replace("category", F.lit("_"), F.lit("-")), F.lit(" plans"))) <= 32)
    return rows.select("entry_id", fx.derived_triggers(F.col("description"), F.col("body")).alias("found"), fx.derived_exclusions(F.col("description")).alias("excluded"))


_LOW = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(prompt, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_+', ' ', 'g'), '\s+', ' ', 'g')))"
_KIND = "case " + " ".join("when " + " or ".join(f"contains(low, '{h}')" if not h.isascii() else f"regexp_matches(low, '(?:^|[^a-z0-9_]){h}(?:$|[^a-z0-9_])')" for h in hints) + f" then '{name}'" for name, hints in HINTS) + " end"
K = f"""t0 as (select task_id, prompt, {_LOW} as low, lower(trim(regexp_replace(prompt, '\\s+', ' ', 'g'))) as task from (select lower(trim(id)) as task_id, max(prompt) as prompt from evals where id is not null group by 1)),
t as (select *, {_KIND} as kind, list_distinct(regexp_extract_all(task, '[a-z0-9_]+') || coalesce(flatten(list_transform(regexp_extract_all(task, '{CJK}+'), lambda r: case when length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end)), [])) as toks from t0)
"""


def _tasks(spark: SparkSession, folder: str) -> DataFrame:
    prompts = table(spark, folder, "evals").where("id is not null").groupBy(F.lower(F.trim("id")).alias("task_id")).agg(F.max("prompt").alias("prompt"))
    task = prompts.select("task_id", squeeze(F.col("prompt")).alias("task"), fx.first_hint(F.col("prompt"), HINTS).alias("kind"))
    return task.withColumn("tokens", F.array_distinct(tokens(F.col("task"))))


@book.query("with " + K + "select task_id, kind from t")
def t12_first_hint(spark: SparkSession, folder: str) -> DataFrame:
    return _tasks(spark, folder).select("task_id", "kind")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("worst") >= 3, "active").when(F.col("worst") == 2, "deprecated").when(F.col("n") == 1, "blocked").otherwise("active")
    rows = _described(spark, folder).select(
        F.col("entry_id").alias("id"), "category", status.alias("status"), (F.col("n") * 5.0).alias("score"), (F.col("n") * 30).alias("root_lines"),
        F.array_distinct(F.concat(F.split("words", " "), tokens(F.lower("entry_id")), tokens(F.lower(fx.positive_clause(F.col("description")))))).alias("surface"),
        F.array(F.col("words"), F.lit("snapshot writer"), F.lit("检查代码")).alias("include"), F.array(F.lit("release order plans"), F.lit("发布"), F.concat(F.lit("order "), F.col("words"))).alias("exclude"),
        F.array("category").alias("tags"), (status != "blocked").alias("live"),
    )
    return with_replacement(rows.select("*", F.col("id").alias("position")), ["category"], "tags", "position").withColumnRenamed("id", "entry_id").drop("position", "live")


R = D + ", " + K + f""", s0 as (select entry_id, category, words, n, case when worst >= 3 then 'active' when worst = 2 then 'deprecated' when n = 1 then 'blocked' else 'active' end as status, description from e),
s as (select *, n * 5.0::double as past, n * 30 as root_lines, (select min(o.entry_id) from s0 o where o.category = s0.category and o.entry_id <> s0.entry_id and o.status <> 'blocked') as replacement,
  list_distinct(string_split(words, ' ') || regexp_extract_all(lower(entry_id), '[a-z0-9_]+') || regexp_extract_all(lower({_POSITIVE}), '[a-z0-9_]+') || ['检查', '查代', '代码']) as surface from s0),
p as (select *, least(1.0::double, len(list_intersect(surface, toks)) / 2::double) as tag,
  case when contains(task, words) or (len(string_split(words, ' ')) = 1 and list_contains(toks, words)) or (len(list_distinct(string_split(words, ' '))) > 1 and len(list_intersect(string_split(words, ' '), toks)) >= 2 and 2 * len(list_intersect(string_split(words, ' '), toks)) >= len(list_distinct(string_split(words, ' '))))
    or contains(task, 'snapshot writer') or len(list_intersect(['snapshot', 'writer'], toks)) = 2 or contains(task, '检查代码') or len(list_intersect(['检查', '查代', '代码'], toks)) >= 2 then 1.0 else 0.0 end::double as trigger,
  coalesce((lower(category) = kind)::int, 0)::double as category_part, least(1.0::double, past / 100) as history, 1 - least(1.0::double, root_lines / 400::double) as context,
  case when status = 'blocked' then 'blocked' when contains(task, 'release order plans') or (contains(task, 'release') and contains(task, 'order') and contains(task, 'plans')) or contains(task, '发布') or contains(task, 'order ' || words)
    or (len(regexp_extract_all('order ' || words, '[a-z0-9]{{4,}}')) >= 2 and len(list_filter(regexp_extract_all('order ' || words, '[a-z0-9]{{4,}}'), lambda w: not contains(task, w))) = 0) then 'excluded_phrase'
    when status = 'deprecated' and replacement is not null then 'replaced' end as reason from t cross join s),
q as (select *, round(tag * 0.45::double + trigger * 0.25::double + category_part * 0.15::double + history * 0.1::double + context * 0.05::double, 6) as score from p where tag > 0 or trigger > 0 or category_part > 0)
"""


@book.query(R + "select task_id, reason, count(*) as n from q where reason is not null group by all")
def f8_exclude_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates are out for each task, by reason."""
    rows = routing.scored_routes(_tasks(spark, folder), _entries(spark, folder)).where("tag > 0 or trigger > 0 or category_part > 0")
    return rows.where("reason is not null").groupBy("task_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@book.query(R + """, b as (select *, max(score) over (partition by task_id) as best from q where reason is null), k as (select *, row_number() over (partition by task_id order by score desc, entry_id) as place from b where score >= 0.12 and score >= 0.45::double * best)
select task_id, entry_id, score, place from k where place <= 5""")
def g7_full_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Routes by all five parts of the score, behind the hard filter."""
    return routing.full_routes(_tasks(spark, folder), _entries(spark, folder)).withColumn("place", F.col("place").cast("long"))


QUERIES, SQL = book.queries, book.sql
