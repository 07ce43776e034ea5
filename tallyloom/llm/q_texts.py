"""Queries of answers: defects, text types, repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.pairs import CHECKS, defective, with_prompts
from tallyloom.llm.repetition import SCORED, repetitive, shares
from tallyloom.llm.texttypes import is_no_prose, measure, no_prose, typed
from tallyloom.operators.scale import tasks_for
from tallyloom.session import cut
from tallyloom.sources import table


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run_key, origin, id, output, received_at): the rows of both tables."""
    parts = [
        table(spark, folder, name).select("run_key", F.lit(name).alias("origin"), "id", "output", "received_at")
        for name in ("runs_r10", "blind_r2_c1")
    ]
    return parts[0].unionByName(parts[1]).where("run_key is not null")


def latest(rows: DataFrame) -> DataFrame:
    """(run_key, origin, id, output): each run once, as received last. The partitions are made for the Python work that
    follows, which needs more of them than so few bytes would get."""
    last = rows.repartition(tasks_for(rows), "run_key").groupBy("run_key").agg(F.max(F.struct("received_at", "origin", "id", "output")).alias("r"))
    return last.select("run_key", "r.origin", "r.id", "r.output")


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    return latest(runs(spark, folder))


def typed_outputs(spark: SparkSession, folder: str, **more) -> DataFrame:
    """(key, kind, ...): outputs with their type. The measured rows, without the texts, are written once, since the model
    reads them before they are typed."""
    return typed(cut(measure(outputs(spark, folder), "run_key", "output", **more)))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The types are learned from the outputs of both tables, so one pass measures all and examines those with a prompt."""
    rows = outputs(spark, folder).withColumnsRenamed({"run_key": "key", "output": "text"})
    pairs = with_prompts(rows, table(spark, folder, "evals").select("id", "prompt"), F.col("origin") == "runs_r10")
    seen = typed(cut(measure(pairs.repartition(tasks_for(runs(spark, folder)), "key"), "key", "text", ("judged",), CHECKS, ("prompt", "judged"))))
    return defective(seen.where(~is_no_prose())).select(F.col("key").alias("run_key"), "defect")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return no_prose(typed_outputs(spark, folder)).select(F.col("key").alias("run_key"), "kind")


def p3_types(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior of every type for every output."""
    return typed_outputs(spark, folder).select(F.col("key").alias("run_key"), "kind", *[F.round(f"p_{t}", 6).alias(f"p_{t}") for t in ("prose", "list", "table", "junk")])


#: Common words of the statistics, all languages of the prompts together.
COMMON = "the a an and or of to in is are was were it that this which for on at by from as not no we you they has have will can der die das den und oder nicht ist wird mit von für auf zu im dass weil le la les des du et est sont que qui pour dans sur avec el los las del y es son para por con se".split()


def p3_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Word count, mean word length, symbol ratio, share of lines ending in punctuation, share of common words."""
    text = F.regexp_replace(F.coalesce("output", F.lit("")), r"\r\n?", "\n")
    words = F.filter(F.split(F.regexp_replace(F.lower("t"), r"[^\p{L}\p{M}]+", " "), " "), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"\S"))
    rows = outputs(spark, folder).select("run_key", text.alias("t")).withColumn("w", words).withColumn("l", lines)
    n = F.size("w")
    seen = F.length(F.regexp_replace("t", r"\s+", ""))
    letters = F.length(F.regexp_replace("t", r"[^\p{L}\p{M}\p{N}]+", ""))
    ended = F.size(F.filter("l", lambda x: x.rlike(r"[.!?。！？…][\"')\]”’」』）]*\s*$")))
    common = F.size(F.filter("w", lambda w: w.isin(*COMMON)))
    return rows.select(
        "run_key",
        n.cast("long").alias("word_count"),
        F.when(n > 0, F.round(F.length(F.concat_ws("", "w")) / n, 6)).otherwise(0.0).alias("mean_word_length"),
        F.when(seen > 0, F.round((seen - letters) / seen, 6)).otherwise(0.0).alias("symbol_ratio"),
        F.when(F.size("l") > 0, F.round(ended / F.size("l"), 6)).otherwise(0.0).alias("ended_line_share"),
        F.when(n > 0, F.round(common / n, 6)).otherwise(0.0).alias("common_word_share"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rest = typed_outputs(spark, folder, also=SCORED).where(~is_no_prose()).select("key", "stratum", "score")
    return repetitive(rest, lambda keys: latest(runs(spark, folder).join(F.broadcast(keys), F.col("run_key") == F.col("key"), "left_semi")).select(F.col("run_key").alias("key"), F.col("output").alias("text"))).select(F.col("key").alias("run_key"))


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of repeated content of every output."""
    return shares(outputs(spark, folder), "run_key", "output").select(F.col("key").alias("run_key"), F.round("share", 6).alias("share"))


P3_STATS_SQL = r"""
with o as (
  select run_key, regexp_replace(coalesce(output, ''), '\r\n?', chr(10), 'g') as t from (
    select run_key, output, row_number() over (partition by run_key order by received_at desc, id desc, output desc nulls last) as rn from (
      select run_key, id, output, received_at from runs_r10 union all select run_key, id, output, received_at from blind_r2_c1) where run_key is not null) where rn = 1),
p as (
  select run_key, t, list_filter(string_split(regexp_replace(lower(t), '[^\p{L}\p{M}]+', ' ', 'g'), ' '), lambda w: w <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) as l,
    length(regexp_replace(t, '\s+', '', 'g')) as seen, length(regexp_replace(t, '[^\p{L}\p{M}\p{N}]+', '', 'g')) as letters from o)
select run_key, len(w) as word_count,
  case when len(w) > 0 then round(length(array_to_string(w, '')) / len(w), 6) else 0.0 end as mean_word_length,
  case when seen > 0 then round((seen - letters) / seen, 6) else 0.0 end as symbol_ratio,
  case when len(l) > 0 then round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?。！？…]["'')\]”’」』）]*\s*$'))) / len(l), 6) else 0.0 end as ended_line_share,
  case when len(w) > 0 then round(len(list_filter(w, lambda x: list_contains([__COMMON__], x))) / len(w), 6) else 0.0 end as common_word_share
from p
""".replace("__COMMON__", ", ".join(f"'{w}'" for w in COMMON))

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_types": p3_types, "p3_stats": p3_stats, "p5_found": p5_found, "p5_shares": p5_shares}
SQL = {"p3_stats": P3_STATS_SQL}
