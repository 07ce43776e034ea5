"""Selections under budgets: by priority with caps, over-budget lists, unions in order, windows around hits, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much of each kind of extra material a risk level takes.
CAPS = {
    "LOW": {"refs": 0, "callees": 0, "tests": 0, "config": 0, "rules": 0},
    "MEDIUM": {"refs": 40, "callees": 20, "tests": 0, "config": 0, "rules": 0},
    "HIGH": {"refs": 60, "callees": 30, "tests": 4, "config": 4, "rules": 3},
    "CRITICAL": {"refs": 80, "callees": 40, "tests": 6, "config": 6, "rules": 5},
}


def by_priority(rows: DataFrame, path: str, reason: str, priority: str, n: int) -> DataFrame:
    """(path, reason, priority): each path once with its most urgent reason, the ``n`` most urgent paths (a top-k)."""
    best = rows.groupBy(path).agg(F.min(F.struct(priority, reason)).alias("b")).select(path, F.col(f"b.{reason}").alias(reason), F.col(f"b.{priority}").alias(priority))
    return best.orderBy(priority, path).limit(n)


def within_caps(rows: DataFrame, level: str, kind: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The first rows of every (keys, kind) that the level's caps take.

    Rows beyond the largest cap are dropped inside salted parts first, so no task sorts all rows of a kind.
    """
    cap = F.lit(0)
    for name, caps in CAPS.items():
        for k, most in caps.items():
            cap = F.when((F.col(level) == name) & (F.col(kind) == k), most).otherwise(cap)
    capped = rows.withColumn("_cap", cap).where("_cap > 0").withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    part = Window.partitionBy(*keys, level, kind, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys, level, kind).orderBy(*order)
    few = capped.withColumn("_n", F.row_number().over(part)).where("_n <= _cap")
    return few.withColumn("_n", F.row_number().over(whole)).where("_n <= _cap").drop("_cap", "_salt", "_n")


def over_budget(rows: DataFrame, item: str, size: Column, most: int) -> DataFrame:
    """(item, size) above the budget, heaviest first."""
    return rows.select(item, size.alias("size")).where(F.col("size") > most).orderBy(F.desc("size"), item)


def union_in_order(*arrays: Column) -> Column:
    """Members of all arrays, each once, in the order of their first place."""
    return F.array_distinct(F.concat(*arrays))


def evidence(*parts: tuple[DataFrame, str, Column, Column, Column]) -> DataFrame:
    """(kind, id, claim, status): records of several shapes as one; each part is (rows, kind, id, claim, status)."""
    out = None
    for rows, kind, id_, claim, status in parts:
        one = rows.select(F.lit(kind).alias("kind"), id_.cast("string").alias("id"), claim.cast("string").alias("claim"), status.cast("string").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def near_hits(lines: DataFrame, key: str, number: str, text: str, name: str, reach: int = 8, most: int = 5) -> DataFrame:
    """(key, hit, number): the lines within ``reach`` of each of the first ``most`` lines of a text that hold a name.

    Each hit is unfolded to the few numbers around it, so the join is on (key, number).
    """
    w = Window.partitionBy(key).orderBy(number)
    hits = lines.where(F.contains(text, F.lit(name))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    around = hits.select(key, F.col(number).alias("hit"), F.explode(F.sequence(F.col(number) - reach, F.col(number) + reach)).alias(number))
    return around.join(lines.select(key, number), [key, number])


def with_verdict(challenges: DataFrame, verdicts: DataFrame, id_: str) -> DataFrame:
    """``challenges`` with ``outcome``: the verdict on each, its own status where there is none."""
    last = verdicts.groupBy(id_).agg(F.max_by("verdict", "at").alias("_verdict"))
    return challenges.join(last, id_, "left").withColumn("outcome", F.coalesce("_verdict", "status")).drop("_verdict")


def accepted_risk(rows: DataFrame, risks: Sequence[tuple[str, str | None, str | None, str]], today: str, glob_to_regex) -> DataFrame:
    """Adds ``risk``: the first accepted risk (name, finding id, rule glob, expiry) that is not expired on ``today`` and whose
    id or rule fits. Risks are configuration, so they are compiled into one expression."""
    out = F.lit(None).cast("string")
    for name, finding, rule, until in reversed(list(risks)):
        fits = F.lit(False)
        if finding:
            fits = fits | (F.col("id") == finding)
        if rule:
            fits = fits | F.col("rule_id").rlike("^" + glob_to_regex(rule) + "$")
        if until >= today:
            out = F.when(fits, name).otherwise(out)
    return rows.withColumn("risk", out)
