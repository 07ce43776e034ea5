"""Registry queries and routing: banded top-k of entries for a task, by shared tokens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.descriptions import excludes
from tallyloom.functions.text import clamp01, squeeze, tokens
from tallyloom.operators.scores import banded_top
from tallyloom.session import cut

#: Weights of a route's parts.
ROUTE_WEIGHTS = {"tags": 0.45, "triggers": 0.25, "category": 0.15, "history": 0.10, "context": 0.05}


def registry_query(entries: DataFrame, tags: Sequence[str], status: str | None = None, least: float | None = None, n: int | None = None) -> DataFrame:
    """Entries with any of the tags, a status and a least score, in registry order. A score of 0 counts as none."""
    out = entries
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if status is not None:
        out = out.where(F.col("status") == status)
    if least is not None:
        out = out.where(F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.lit(-1.0)) >= least)
    out = out.orderBy("entry_id")
    return out if n is None else out.limit(n)


#: Hits from which the tag part is full, lines at which the context part is empty, least total of a route.
FULL_TAGS, FULL_LINES, LEAST_ROUTE = 2, 400, 0.12


def exclude_reason(task: Column) -> Column:
    """Why an entry is out for a task (squeezed): ordered checks, null for none. Entry columns: status, exclude (phrases),
    replacement (another entry that does the same, or null)."""
    return (
        F.when(F.col("status") == "blocked", "blocked")
        .when(excludes(task, F.col("exclude")), "excluded_phrase")
        .when((F.col("status") == "deprecated") & F.col("replacement").isNotNull(), "replaced")
    )


def candidates(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    """(task_id, entry_id) that share a token of the entry's surface or triggers, or whose category is the task's kind.

    Everything a route can score points for is one of these, so the other pairs are never made.
    """
    index = entries.select("entry_id", F.explode(F.array_distinct(F.concat("surface", F.flatten(F.transform("include", lambda p: tokens(squeeze(p))))))).alias("token"))
    asked = tasks.select("task_id", F.explode(F.array_distinct("tokens")).alias("token"))
    by_kind = tasks.select("task_id", F.col("kind").alias("category")).join(entries.select("entry_id", F.lower("category").alias("category")), "category").select("task_id", "entry_id")
    return asked.join(index, "token").select("task_id", "entry_id").unionByName(by_kind).distinct()


def scored_routes(tasks: DataFrame, entries: DataFrame) -> DataFrame:
    """(task_id, entry_id, tag, trigger, category_part, history, context, score, reason) of every candidate.

    ``tasks`` is (task_id, task, tokens, kind), ``task`` squeezed; ``entries`` has entry_id, surface (tokens), include and
    exclude (phrases), category, status, score (0 to 100 or null), root_lines, replacement. A trigger fires if the task
    holds it, or at least two and half of its tokens (its only token). Entries with a reason are out; their score is kept.
    """
    pairs = candidates(tasks, entries).join(tasks, "task_id").join(entries.withColumnRenamed("score", "past"), "entry_id")

    def fires(phrase: Column) -> Column:
        p = squeeze(phrase)
        own = F.array_distinct(tokens(p))
        both = F.size(F.array_intersect(own, F.col("tokens")))
        return (p != "") & (F.contains("task", p) | F.when(F.size(own) == 1, both == 1).otherwise((both >= 2) & (both * 2 >= F.size(own))))

    parts = {
        "tag": F.least(F.lit(1.0), F.size(F.array_intersect(F.array_distinct("surface"), F.col("tokens"))) / F.lit(FULL_TAGS)),
        "trigger": F.exists("include", fires).cast("int").cast("double"),
        "category_part": F.coalesce((F.lower("category") == F.col("kind")).cast("int").cast("double"), F.lit(0.0)),
        "history": clamp01(F.coalesce("past", F.lit(0.0)) / 100),
        "context": 1 - clamp01(F.coalesce("root_lines", F.lit(0)) / F.lit(float(FULL_LINES))),
    }
    total = sum((F.col(name) * w for name, w in zip(parts, ROUTE_WEIGHTS.values(), strict=True)), F.lit(0.0))
    return pairs.withColumns(parts).select("task_id", "entry_id", *parts, F.round(total, 6).alias("score"), exclude_reason(F.col("task")).alias("reason"))


def _profiles(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(profile, entry_id, heard, include, exclude, category, history, context): the entries that are not out for every task,
    the first ``k`` by id of each profile.

    Entries of one profile score alike for every task: they are heard by the same asked tokens and are equal in phrases,
    category, history and context. As equal scores go by id, the others of a profile are in no task's best ``k``.
    """
    out = (F.col("status") == "blocked") | ((F.col("status") == "deprecated") & F.col("replacement").isNotNull())
    phrases = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), squeeze), lambda p: p != "")))
    rows = entries.where(~F.coalesce(out, F.lit(False))).select(
        "entry_id", "surface", phrases(F.col("include")).alias("include"), phrases(F.col("exclude")).alias("exclude"), F.lower("category").alias("category"),
        clamp01(F.coalesce("score", F.lit(0.0)) / 100).alias("history"), (1 - clamp01(F.coalesce("root_lines", F.lit(0)) / F.lit(float(FULL_LINES)))).alias("context"),
    )
    heard = rows.select("entry_id", F.explode(F.array_distinct("surface")).alias("token")).join(asked.select("token").distinct().hint("merge"), "token")
    heard = heard.groupBy("entry_id").agg(F.array_sort(F.collect_set("token")).alias("heard"))
    rows = rows.drop("surface").join(heard, "entry_id", "left").withColumn("heard", F.coalesce("heard", F.array().cast("array<string>")))
    w = Window.partitionBy("heard", "include", "exclude", "category", "history", "context").orderBy("entry_id")
    return rows.withColumns({"_n": F.row_number().over(w), "profile": F.first("entry_id").over(w)}).where(F.col("_n") <= k).drop("_n")


def _holds(asks: DataFrame, profiles: DataFrame, phrases: str, hit) -> DataFrame:
    """(task_id, profile, history, context): asks that hold a phrase of the profile. Each phrase is tried once a task."""
    said = profiles.select("profile", "history", "context", F.explode(phrases).alias("phrase"))
    one = said.select("phrase").distinct().agg(F.collect_list(F.struct("phrase", F.array_distinct(tokens(F.col("phrase"))).alias("own"))).alias("all"))
    found = asks.crossJoin(F.broadcast(one)).select("task_id", F.explode(F.filter("all", hit)["phrase"]).alias("phrase"))  # one row
    return found.join(said.hint("merge"), "phrase")


def full_routes(tasks: DataFrame, entries: DataFrame, k: int = 5) -> DataFrame:
    """(task_id, entry_id, score, place): the best ``k`` of each task among those that are not out and relevant (a tag, a
    trigger or the category), at least LEAST_ROUTE and in the band of the best.

    Columns and parts are those of :func:`scored_routes`; ``task_id`` and ``entry_id`` are unique. Tasks that say the same
    are routed once, entries that score alike are scored once (see :func:`_profiles`), and phrases are tried on tasks, not
    on pairs of tasks and entries. Pairs are counted on the map side from what a task and a profile have in common.
    """
    # Both are read many times below, so the plan would grow with every use.
    known = cut(tasks.select("task_id", "task", "tokens", "kind", F.min("task_id").over(Window.partitionBy("task", "tokens", "kind")).alias("_ask")))
    asks = known.where("task_id = _ask").drop("_ask")
    asked = asks.select("task_id", F.explode(F.array_distinct("tokens")).alias("token"))
    members = cut(_profiles(entries, asked, k))
    profiles = members.where("entry_id = profile")

    def fires(p: Column) -> Column:
        both = F.size(F.array_intersect(p["own"], F.col("tokens")))
        return F.contains("task", p["phrase"]) | F.when(F.size(p["own"]) == 1, both == 1).otherwise((both >= 2) & (both * 2 >= F.size(p["own"])))

    heard = asked.join(profiles.select("profile", "history", "context", F.explode("heard").alias("token")).hint("merge"), "token")
    of_kind = asks.select("task_id", F.col("kind").alias("category")).join(profiles.select("profile", "history", "context", "category").hint("merge"), "category")
    shared = {"tag": heard, "trigger": _holds(asks, profiles, "include", fires), "category_part": of_kind, "out": _holds(asks, profiles, "exclude", lambda p: excludes(F.col("task"), F.array(p["phrase"])))}
    flags = [rows.select("task_id", "profile", "history", "context", *[F.lit(int(name == other)).alias(other) for other in shared]) for name, rows in shared.items()]
    most = [F.max(c).alias(c) for c in ("trigger", "category_part", "out", "history", "context")]
    pairs = reduce(DataFrame.unionByName, flags).groupBy("task_id", "profile").agg(F.sum("tag").alias("tag"), *most).where("out = 0")
    parts = {"tag": F.least(F.lit(1.0), F.col("tag") / F.lit(FULL_TAGS)), "trigger": F.col("trigger").cast("double"), "category_part": F.col("category_part").cast("double"), "history": F.col("history"), "context": F.col("context")}
    total = sum((part * w for part, w in zip(parts.values(), ROUTE_WEIGHTS.values(), strict=True)), F.lit(0.0))
    # A profile goes by its first entry, so the best k entries stand in the best k profiles.
    place = F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "profile"))
    top = pairs.select("task_id", "profile", F.round(total, 6).alias("score")).withColumn("_n", place).where(F.col("_n") <= k)
    rows = top.join(members.select("profile", "entry_id").hint("merge"), "profile").select("task_id", "entry_id", "score")
    best = banded_top(rows, ["task_id"], "score", "entry_id", k, LEAST_ROUTE)
    return known.select("task_id", "_ask").join(best.withColumnRenamed("task_id", "_ask").hint("merge"), "_ask").drop("_ask")


def routes(tasks: DataFrame, entries: DataFrame, k: int = 3, least: float = 0.05) -> DataFrame:
    """(task_id, entry_id, score, place) by shared tokens, through an inverted index instead of all pairs.

    ``tasks`` is (task_id, tokens), ``entries`` (entry_id, tags, history). The share of an entry's tags that a task
    names weighs with the tag weight, the entry's history with its own; entries without a shared token have no route.
    """
    index = entries.select("entry_id", F.size("tags").alias("_n"), "history", F.explode(F.array_distinct("tags")).alias("token"))
    asked = tasks.select("task_id", F.explode(F.array_distinct("tokens")).alias("token"))
    shared = asked.join(index, "token").groupBy("task_id", "entry_id").agg(F.count(F.lit(1)).alias("shared"), F.first("_n").alias("_n"), F.first("history").alias("history"))
    score = ROUTE_WEIGHTS["tags"] * F.col("shared") / F.col("_n") + ROUTE_WEIGHTS["history"] * F.col("history")
    scored = shared.select("task_id", "entry_id", F.round(score, 6).alias("score"))
    return banded_top(scored, ["task_id"], "score", "entry_id", k, least)
