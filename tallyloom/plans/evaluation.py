"""Queries of text scores, judges and specialists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import evaluation as ops
from tallyloom.plans.base import Book
from tallyloom.sources import table

book = Book()
#: Patterns of filler that the queries look for.
FILLER = ("(?i)as far as we can tell", "简单说|顺带一提", "(?i)by the way")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Each run once, as received last."""
    rows = table(spark, folder, "runs_r10").where("run_key is not null")
    last = rows.groupBy("run_key").agg(F.max(F.struct("received_at", F.coalesce("output", F.lit("")).alias("output"), "id", "cond", "probe_expect")).alias("r"))
    return last.select("run_key", "r.id", "r.cond", "r.probe_expect", F.col("r.output").alias("text"), F.lower(F.trim("r.id")).alias("case_id"))


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each case: the row with the greatest id, of repeated ones the same checks."""
    return table(spark, folder, "evals").groupBy(F.lower(F.trim("id")).alias("case_id")).agg(F.max(F.struct("prompt", "sticky", "check_rules")).alias("c")).select("case_id", F.col("c.sticky").alias("sticky"), F.col("c.check_rules").alias("check"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return ops.scored(_runs(spark, folder).join(_cases(spark, folder), "case_id"), FILLER)


def _words_sql(column: str) -> str:
    return "case f" + "".join(f" when '{k}' then regexp_matches({column}, '{v}')" for k, v in ops.FIELD_WORDS.items()) + " else false end"


_LONG = "list_filter(full_lines, lambda x: length(x) >= 12)"
S = f"""with r as (select run_key, coalesce(output, '') as text, cond, probe_expect, lower(trim(id)) as case_id from (
    select *, row_number() over (partition by run_key order by received_at desc, coalesce(output, '') desc, id desc nulls last, cond desc nulls last, probe_expect desc nulls last) as rn from runs_r10 where run_key is not null) where rn = 1),
e as (select case_id, c.sticky as sticky, c.check_rules as chk from (select lower(trim(id)) as case_id, max({{'prompt': prompt, 'sticky': sticky, 'check_rules': check_rules}}) as c from evals group by 1)),
p as (select *, length(text) as n, list_transform(list_filter(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\\S')), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as full_lines,
    list_transform(regexp_extract_all(text, '(?m)^(#{{1,6}})\\s', 1), lambda x: length(x)) as levels, coalesce(list_filter(chk.require_fields, lambda x: x is not null), []) as wanted, coalesce(list_filter(chk.must_regex, lambda x: x is not null), []) as must from r join e using (case_id)),
q as (select *, greatest(len(regexp_extract_all(text, '[。！？!?]|\\.\\s')), len(full_lines)) as sentences from p),
d as (select *,
  case when {" or ".join(f"regexp_matches(text, '(?m){p}')" for p in FILLER)} then 0.0 else 100.0 end::double as filler,
  case when len(must) > 0 then 100.0::double * len(list_filter(must, lambda p: regexp_matches(text, '(?m)' || p))) / len(must) else 100.0 end as accuracy,
  case when chk.min_chars is not null then 100.0::double * least(1.0, n / (chk.min_chars * 0.6::double)) else 100.0 end as fidelity,
  case when len(wanted) > 0 then 100.0::double * len(list_filter(wanted, lambda f: {_words_sql("text")})) / len(wanted) else 100.0 end as preserve,
  100.0::double * coalesce(least(case when chk.max_chars is not null then case when n <= chk.max_chars then 1.0::double else chk.max_chars / greatest(n, 1)::double end end,
    case when chk.max_sentences is not null then case when sentences <= chk.max_sentences then 1.0::double else chk.max_sentences / greatest(sentences, 1)::double end end), 1.0) as brevity,
  case when chk.min_chars is not null or coalesce(chk.must_numbers, false) then 100.0::double * (case when chk.min_chars is not null then least(1.0::double, n / greatest(chk.min_chars, 1)::double) else 0 end
    + case when coalesce(chk.must_numbers, false) and regexp_matches(text, '[0-9]') then 1.0::double else 0 end) / ((chk.min_chars is not null)::int + coalesce(chk.must_numbers, false)::int) else 100.0 end as adapt,
  100.0::double * ((not regexp_matches(text, '\\n[ \\t]*\\n[ \\t]*\\n'))::int + (len({_LONG}) = len(list_distinct({_LONG})))::int
    + (len(list_filter(range(1, len(levels)), lambda i: levels[i + 1] > levels[i] + 1)) = 0)::int + (not regexp_matches(text, '(?m)[ \\t]+$'))::int + (not coalesce(regexp_matches(full_lines[len(full_lines)], '^[-—=*_]{{3,}}$'), false))::int) / 5 as discipline from q),
k as (select *, case when coalesce(sticky, false) and not (filler >= 100 and accuracy >= 80 and adapt >= 80 and preserve >= 60 and fidelity >= 80) then 0.0 else 100.0 end::double as stick from d),
s as (select run_key, case_id, cond, probe_expect, sticky, {", ".join(f"round({x}, 4) as {x}" for x in ops.WEIGHTS)} from k),
t as (select *, round(({" + ".join(f"{x} * {w}::double" for x, w in ops.WEIGHTS.items())}) / {sum(ops.WEIGHTS.values())}::double, 1) as total from s)
"""


@book.query(S + f"select run_key, {', '.join(ops.WEIGHTS)}, total from t")
def g8_text_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every answer in the eight dimensions of its case."""
    return _scored(spark, folder).select("run_key", *ops.WEIGHTS, "total")


@book.query(S + f"select cond, count(*) as n, round(avg(total), 4) as total, {', '.join(f'round(avg({x}), 4) as {x}' for x in ops.WEIGHTS if x != 'stick')}, round(avg(case when coalesce(sticky, false) then (stick >= 100)::int end), 6) as sticky_rate from t group by 1")
def a15_eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ops.score_summary(_scored(spark, folder), ["cond"])


@book.query(S + f"""select probe_expect as probe, count(*) as planted, count(*) filter (least({', '.join(ops.WEIGHTS)}) < 100) as failed,
  round(count(*) filter ((least({', '.join(ops.WEIGHTS)}) < 100) = (probe_expect = 'expect-block')) / count(*), 6) as as_expected from t where probe_expect is not null group by 1""")
def a18_probe_rate(spark: SparkSession, folder: str) -> DataFrame:
    return ops.probe_rate(_scored(spark, folder), "probe_expect", "expect-block")


def _judge_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A judge's line for each run, its marks made from the run's columns; runs without an output give a broken line."""
    n = F.length("text")
    marks = {"correctness": n % 5 + 1, "actionability": F.col("run_key") % 5 + 1, "concision": (n + F.col("run_key")) % 5 + 1, "autonomy": F.length("case_id") % 5 + 1, "safety": F.lit(5)}
    rows = _runs(spark, folder)
    line = F.to_json(F.struct("case_id", F.coalesce("cond", F.lit("none")).alias("label"), *[c.cast("int").alias(m) for m, c in marks.items()], (n < 20).alias("blocker"), F.lit("a \"note\"").alias("notes")))
    return rows.select(F.when(n == 0, F.lit('{"case_id": 1, ')).otherwise(line).alias("line"))


J = S.split("e as (")[0] + """j as (select case_id, coalesce(cond, 'none') as label, length(text) % 5 + 1 as correctness, run_key % 5 + 1 as actionability, (length(text) + run_key) % 5 + 1 as concision, length(case_id) % 5 + 1 as autonomy, 5 as safety, length(text) < 20 as blocker from r where length(text) > 0 and case_id is not null),
bad as (select count(*) as n from r where length(text) = 0)
"""


@book.query(J + "select true as bad, n from bad where n > 0 union all select false, count(*) from r where length(text) > 0 having count(*) > 0")
def s10_judge_lines(spark: SparkSession, folder: str) -> DataFrame:
    return ops.read_judges(_judge_lines(spark, folder), "line").groupBy("bad").agg(F.count(F.lit(1)).alias("n"))


@book.query(J.replace(" and case_id is not null", "") + """, k as (select distinct lower(trim(id)) as case_id from evals), c as (select case when label = 'none' or k.case_id is null then null else label end as cond, j.* from j left join k using (case_id))
select cond, count(*) as n, round(avg(correctness) filter (cond is not null), 6) as correctness, round(avg(actionability) filter (cond is not null), 6) as actionability, round(avg(concision) filter (cond is not null), 6) as concision,
  round(avg(autonomy) filter (cond is not null), 6) as autonomy, round(avg(safety) filter (cond is not null), 6) as safety,
  round(avg(correctness * 0.3::double + actionability * 0.2::double + concision * 0.25::double + autonomy * 0.15::double + safety * 0.1::double) filter (cond is not null), 6) as weighted, count(*) filter (blocker) as blockers from c group by 1""")
def a16_judge_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Judges' lines joined to conditions by case and label."""
    labels = F.explode(F.array(*[F.lit(c) for c in ("C0", "C1", "C2")])).alias("label")
    key = table(spark, folder, "evals").select(F.lower(F.trim("id")).alias("case_id")).distinct().select("case_id", labels).withColumn("cond", F.col("label"))
    return ops.judge_summary(ops.read_judges(_judge_lines(spark, folder), "line"), key)


@book.query("""with c as (select distinct lower(trim(id)) as case_id from evals), l as (select case_id, label from c, (values ('A'), ('B'), ('C')) v(label))
select case_id, label, row_number() over (partition by case_id order by sha256('r10:' || case_id || ':' || label), label) as place from l where case_id is not null""")
def h4_seeded_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every case in an order that a seed decides."""
    cases = table(spark, folder, "evals").where("id is not null").select(F.lower(F.trim("id")).alias("case_id")).distinct()
    labels = cases.select("case_id", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))).alias("label"))
    return ops.seeded_order(labels, ["case_id"], "label", "r10").withColumn("place", F.col("place").cast("long"))


_EXPERT = {"CONCURRENCY": "runtime", "PERFORMANCE": "runtime", "DATABASE": "data", "ERROR_HANDLING": "safety", "RESOURCE_SAFETY": "safety"}


@book.query("""with g as (select rule_id, upper(category) as dimension, count(*) as n from findings group by 1, 2), m as (select * from (values ('CONCURRENCY', 'runtime'), ('PERFORMANCE', 'runtime'), ('DATABASE', 'data'), ('ERROR_HANDLING', 'safety'), ('RESOURCE_SAFETY', 'safety')) v(dimension, expert)),
f as (select file, upper(category) as dimension, count(*) as score from findings where file is not null and category is not null group by 1, 2),
e as (select file, expert, min(row_number) as k from (select f.file, m.expert, row_number() over (partition by f.file order by score desc, f.dimension) as row_number from f left join m using (dimension)) where expert is not null group by 1, 2),
x as (select file, coalesce(list(expert order by k) filter (expert is not null), []) as picked from (select distinct file from f) left join e using (file) group by 1)
select file, list_slice(picked || list_filter(['reviewer', 'data', 'safety'], lambda p: not list_contains(picked, p)), 1, 3) as specialists from x""")
def o8_specialists(spark: SparkSession, folder: str) -> DataFrame:
    """The specialists of each file, by the categories that it is reported in most."""
    counts = table(spark, folder, "findings").where("file is not null and category is not null").groupBy("file", F.upper("category").alias("dimension")).agg(F.count(F.lit(1)).alias("score"))
    # One entry for each category of a file: no more than there are categories.
    by_file = counts.groupBy("file").agg(F.collect_list(F.struct("dimension", "score")).alias("scores"))
    return by_file.select("file", ops.specialists(F.col("scores"), _EXPERT, ("reviewer", "data", "safety"), 3).alias("specialists"))


QUERIES, SQL = book.queries, book.sql
