"""Ledger summaries, weighted scores with bands, evaluation summaries, banded top-k, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scale import running_total

#: Weights of the five subscores and grade bands.
SUBSCORE_WEIGHTS = {"success": 0.35, "accuracy": 0.25, "tokens": 0.15, "time": 0.15, "stability": 0.10}
BANDS = ((90.0, "A"), (75.0, "B"), (60.0, "C"), (0.0, "D"))
#: Candidates below this share of the best score are not kept.
BAND = 0.45


def interpolated_percentiles(rows: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, *shares): exact percentiles by linear interpolation at (n - 1) * share; null values do not count.

    Values are reduced to counts, counts are summed up in fixed ranges of the value axis with range offsets, and the values
    at the two ranks around the place are picked, so no task holds a key's values. Keys may be null.
    """
    packed = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, packed.alias("_key"), F.col(value).cast("double").alias("_v"))
    sized = F.floor(F.log2(F.abs(F.col("_v")) + 1) * 16).cast("int")
    counts = kept.groupBy("_key", *keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.when(F.col("_v") < 0, -sized - 1).otherwise(sized))
    placed = running_total(counts, ["_key"], "_range", ["_v"], "_n", "_before", "_all")
    picks = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * F.lit(share)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            picks.append(F.min(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    found = placed.groupBy("_key", *keys).agg(*picks)
    return found.select(*keys, *[(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * F.col(f"_{n}_part")).alias(n) for n in shares])


def ledger_summary(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Averages, debt and percentiles of the measured durations of each key (of all runs without keys)."""
    measured = runs.withColumn("_d", F.when(F.col("duration_ms") >= 0, F.col("duration_ms")))
    summed = measured.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("input_tokens"), 3).alias("avg_input"),
        F.round(F.avg("output_tokens"), 3).alias("avg_output"),
        F.round(F.avg("cache_hit"), 6).alias("cache_hit"),
        F.round(F.avg("dedup_ratio"), 6).alias("dedup_ratio"),
        F.sum("findings").alias("debt"),
    )
    found = interpolated_percentiles(measured, keys, "_d", {"p50": 0.5, "p95": 0.95})
    rounded = [F.round(F.col(p), 4).alias(p) for p in ("p50", "p95")]
    if keys:
        cond = [summed[k].eqNullSafe(found[k]) for k in keys]
        both = summed.join(found, cond, "left").drop(*[found[k] for k in keys])
    else:
        # Two one-row results laid over each other, without a cross join.
        laid = summed.unionByName(found, allowMissingColumns=True)
        both = laid.agg(*[F.max(c).alias(c) for c in laid.columns])
    return both.select(*keys, *[c for c in summed.columns if c not in keys], *rounded)


def grade(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def weighted_score(parts: dict[str, Column]) -> Column:
    """Subscores are rounded before they are weighted."""
    total = F.lit(0.0)
    for name, weight in SUBSCORE_WEIGHTS.items():
        total = total + F.lit(weight) * F.round(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts[name])), 4)
    return F.round(total, 4)


def banded_top(rows: DataFrame, keys: Sequence[str], score: str, item: str, k: int, least: float) -> DataFrame:
    """At most ``k`` items of each key: at least ``least`` and at least BAND of the key's best score.

    The best score is a map-side combined aggregate, and rows below it are gone before any window sorts a key.
    """
    best = rows.groupBy(*keys).agg(F.max(score).alias("_best"))
    kept = rows.join(best, list(keys)).where((F.col(score) >= least) & (F.col(score) >= BAND * F.col("_best")))
    w = Window.partitionBy(*keys).orderBy(F.desc(score), item)
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("_best")


#: Span starts of one block of :func:`islands`.
BLOCK = 4096


def islands(spans: DataFrame, key: str, low: str, high: str, reach: int = 1) -> DataFrame:
    """Merged spans of each key: a span joins the island if it starts within ``reach`` of the furthest end so far.

    Windows run inside blocks of starts; the furthest end and the number of islands of earlier blocks, one row a block,
    are carried in, so a key with very many spans is worked on in many tasks.
    """
    blocked = spans.withColumn("_block", F.floor(F.col(low) / BLOCK))
    ends = blocked.groupBy(key, "_block").agg(F.max(high).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_block", F.max("_end").over(earlier).alias("_carry"))
    w = Window.partitionBy(key, "_block").orderBy(low, high)
    furthest = F.greatest(F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry"))
    marked = blocked.join(carried, [key, "_block"]).withColumn("_new", F.when(F.col(low) <= furthest + reach, 0).otherwise(1))
    inside = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    opened = marked.groupBy(key, "_block").agg(F.sum("_new").alias("_n")).select(key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = marked.withColumn("_inside", inside).join(opened, [key, "_block"]).withColumn("_island", F.col("_inside") + F.col("_offset"))
    return numbered.groupBy(key, "_island").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.count(F.lit(1)).alias("spans")).drop("_island")


def chained_spans(spans: DataFrame, key: str, low: str, length: str) -> DataFrame:
    """Merged spans of each key where a span joins if it starts within the span just before it (its start plus length): only
    the span before counts, not the furthest end so far. Blocks of starts with the last span of the block before carried in."""
    blocked = spans.withColumn("_block", F.floor(F.col(low) / BLOCK))
    lasts = blocked.groupBy(key, "_block").agg(F.max(F.struct(low, length)).alias("_last"))
    before = lasts.select(key, "_block", F.lag("_last").over(Window.partitionBy(key).orderBy("_block")).alias("_carry"))
    w = Window.partitionBy(key, "_block").orderBy(low, length)
    marked = blocked.join(before, [key, "_block"]).withColumn("_prev", F.coalesce(F.lag(F.struct(low, length)).over(w), F.col("_carry")))
    marked = marked.withColumn("_new", F.when(F.col(low) <= F.col(f"_prev.{low}") + F.col(f"_prev.{length}"), 0).otherwise(1))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = marked.groupBy(key, "_block").agg(F.sum("_new").alias("_n")).select(key, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = marked.withColumn("_inside", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(opened, [key, "_block"])
    return numbered.groupBy(key, (F.col("_inside") + F.col("_offset")).alias("_island")).agg(F.min(low).alias("low"), F.max(F.col(low) + F.col(length)).alias("high"), F.count(F.lit(1)).alias("spans")).drop("_island")


def latest_of(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last write wins."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def release_join(manifest: DataFrame, built: DataFrame, installed: DataFrame) -> DataFrame:
    """(name, verdict) of three layers of (name, hash): PASS, DRIFT, MISSING, UNTRACKED."""
    m = manifest.select("name", F.col("hash").alias("m"))
    b = built.select("name", F.col("hash").alias("b"))
    i = installed.select("name", F.col("hash").alias("i"))
    joined = m.join(b, "name", "full_outer").join(i, "name", "full_outer")
    verdict = F.when(F.col("m").isNull(), "UNTRACKED").when(F.col("b").isNull() | F.col("i").isNull(), "MISSING").when((F.col("m") == F.col("b")) & (F.col("b") == F.col("i")), "PASS").otherwise("DRIFT")
    return joined.select("name", verdict.alias("verdict"))
