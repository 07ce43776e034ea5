"""Flags defective prompt and response pairs over a table; the checks themselves are in :mod:`tallyloom.llm.defects`.

Answers are joined to their prompt on the case id (letter case and outer spaces aside) with the answers of a case
spread over ``SPREAD`` salts and the prompt copied to each, so a case with a third of all answers is joined in many
tasks. :data:`CHECKS` are the columns that one pass over whole answers finds, beside whatever else that pass looks for;
the texts themselves go no further. The tails that sentences close with are counted over all answers, and an answer whose
last list item ends in a tail that seldom closes a sentence (``OFTEN``) breaks off.

Defined cases: answers whose id is null or no case's are not judged; a null answer is ``empty``; a null prompt leaves
only the checks that need none; several prompts of one case count as the one that sorts last; repeated answers are
judged each; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.defects import closings, examine
from tallyloom.operators.scale import salt_of

SPREAD = 16
#: A tail closes sentences if it does so in more than this many times the answers that it ends without a terminator.
OFTEN = 2


def case_id(column: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.col(column), r"[\s\x{3000}\x{00A0}]+", " ")))


def with_prompts(answers: DataFrame, cases: DataFrame, judged: Column | None = None) -> DataFrame:
    """``answers`` (key, id, text, ...) with the ``prompt`` of their case and whether they have one (``judged``); where the
    column ``judged`` is false none is looked for.

    Answers to look no case up for are given one of their own, so that they do not meet in one task.
    """
    prompts = cases.where("id is not null").groupBy(case_id("id").alias("_case")).agg(F.max("prompt").alias("prompt"))
    copied = prompts.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_salt"), F.lit(True).alias("judged"))
    asked = F.col("id").isNotNull() & (F.lit(True) if judged is None else judged)
    none = F.concat(F.lit("\u0000"), F.col("key").cast("string"))
    salted = answers.withColumn("_case", F.when(asked, case_id("id")).otherwise(none)).withColumn("_salt", salt_of("key", buckets=SPREAD))
    # The planner does not see that the prompts were unfolded and might take them for small: no broadcast here.
    joined = salted.join(copied.hint("merge"), ["_case", "_salt"], "left").drop("_case", "_salt")
    return joined.withColumn("judged", F.coalesce("judged", F.lit(False)))


def _checked(text: str | None, prompt: str | None, judged: bool) -> dict | None:
    if not judged:
        return None
    defect, tail = examine(text, prompt)
    return {"defect": defect, "tail": tail or None, "closings": sorted(closings(text or ""))}


#: Column of the checks and what it is found from: (text, prompt, judged).
CHECKS = {"checks": ("struct<defect:string,tail:string,closings:array<string>>", _checked)}


def defective(checked: DataFrame) -> DataFrame:
    """(key, defect), one row for each defective answer of (key, judged, checks). ``checked`` is read four times."""
    seen = checked.where("judged").select("key", "checks.*")
    open_ends = seen.where("defect is null and tail is not null").select("key", "tail")
    asked = open_ends.groupBy("tail").agg(F.count(F.lit(1)).alias("asked"))
    closed = seen.select(F.explode("closings").alias("tail")).groupBy("tail").agg(F.count(F.lit(1)).alias("closed"))
    no_close = asked.join(closed, "tail", "left").where(F.coalesce("closed", F.lit(0)) <= OFTEN * F.col("asked")).select("tail")
    broken = open_ends.join(no_close, "tail", "left_semi").select("key", F.lit("truncated").alias("defect"))
    return seen.where("defect is not null").select("key", "defect").unionByName(broken)
