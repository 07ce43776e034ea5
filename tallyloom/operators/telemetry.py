"""Event-log operators: typed projection, one-pass summary, group rates, repeated calls, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alert thresholds; ratio alerts need at least this many events.
LEAST_EVENTS, LOW_SUCCESS, LOW_CACHE, HIGH_LATENCY, HIGH_REPEATS, MANY_CALLS = 5, 0.9, 0.5, 500.0, 0.2, 3.0


def typed(events: DataFrame) -> DataFrame:
    """Telemetry records of the event log. ``props`` is JSON read with a fixed schema; malformed text gives nulls."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("line"),
        "ts",
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        (F.col("user_id") % 4).cast("string").alias("agent_id"),
        F.col("event_type").alias("skill_id"),
        (k % 10).alias("tool_id"),
        (F.col("event_type") != "error").alias("success"),
        F.floor(F.col("value") * 10).alias("latency_ms"),
        (k % 3 == 0).alias("cache_hit"),
        (~((F.col("event_type") == "error") & (k % 50 == 0))).alias("evidence_kept"),
        k.alias("tokens"),
        (k % 6 + 1).alias("calls"),
    )


def summary(events: DataFrame) -> DataFrame:
    """Totals and rates in one aggregate; rates are null for an empty log."""
    n = F.count(F.lit(1))
    return events.agg(
        n.alias("events"),
        F.count_if("success").alias("succeeded"),
        F.round(F.try_divide(F.count_if("success"), n), 6).alias("success_rate"),
        F.sum("tokens").alias("tokens"),
        F.round(F.try_divide(F.count_if("cache_hit"), n), 6).alias("cache_hit_rate"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.count_if(~F.col("evidence_kept")).alias("evidence_lost"),
        F.round(F.avg("calls"), 6).alias("calls_per_event"),
    )


def group_rates(events: DataFrame) -> DataFrame:
    """Success rate by agent, by skill and by both in one pass; empty keys are shown as ``(empty)``."""
    keyed = events.select(_shown("agent_id"), _shown("skill_id"), "success")
    sets = keyed.groupingSets([["agent_id"], ["skill_id"], ["agent_id", "skill_id"]], "agent_id", "skill_id")
    return sets.agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("events"), F.round(F.count_if("success") / F.count(F.lit(1)), 6).alias("success_rate")
    )


def _shown(name: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("(empty)")).alias(name)


def repeats(events: DataFrame) -> DataFrame:
    """Second and later calls with the same session, agent, skill and tool, in the order of the log."""
    w = Window.partitionBy("session_id", "agent_id", "skill_id", "tool_id").orderBy("line")
    return events.withColumn("nth", F.row_number().over(w)).where("nth > 1")


def alerts(summed: DataFrame, repeated: DataFrame, lines: DataFrame) -> DataFrame:
    """Alerts that fired: (code, value, limit). Ratios need LEAST_EVENTS events. ``lines`` is the scan of the log, one row
    with the number of ``malformed`` lines."""
    counted = repeated.agg(F.count(F.lit(1)).alias("repeats"))
    # One-row results laid over each other, without a cross join.
    both = summed.unionByName(counted, allowMissingColumns=True).unionByName(lines.select("malformed"), allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    enough = F.col("events") >= LEAST_EVENTS
    share = F.try_divide(F.col("repeats"), F.col("events"))
    checks = [
        ("LOW_SUCCESS", F.col("success_rate"), LOW_SUCCESS, enough & (F.col("success_rate") < LOW_SUCCESS)),
        ("LOW_CACHE_HIT", F.col("cache_hit_rate"), LOW_CACHE, enough & (F.col("cache_hit_rate") < LOW_CACHE)),
        ("HIGH_LATENCY", F.col("avg_latency_ms"), HIGH_LATENCY, F.col("avg_latency_ms") > HIGH_LATENCY),
        ("EVIDENCE_LOST", F.col("evidence_lost").cast("double"), 0.0, F.col("evidence_lost") > 0),
        ("RETRY_STORM", F.col("calls_per_event"), MANY_CALLS, F.col("calls_per_event") > MANY_CALLS),
        ("MALFORMED_LINES", F.col("malformed").cast("double"), 0.0, F.col("malformed") > 0),
        ("REPEATED_CALLS", F.round(share, 6), HIGH_REPEATS, enough & (share > HIGH_REPEATS)),
    ]
    cells = F.array(*[F.struct(F.lit(c).alias("code"), v.alias("value"), F.lit(float(t)).alias("threshold"), f.alias("fired")) for c, v, t, f in checks])
    return row.select(F.inline(cells)).where("fired").drop("fired")
