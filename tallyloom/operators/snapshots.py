"""What changed between consecutive full snapshots of a table.

Every record of a snapshot is counted with +1 in its own snapshot and with -1 in the repo's next existing one, so that
in each target snapshot a record that stays as it is sums to zero. Two passes of grouped sums do the rest:

1. whole states: (repo, snapshot, key, state) sums cancel everything that did not change, before anything wide moves;
2. cells: the states left over are unpivoted into (key, field, value) cells and a key-presence marker; a presence sum of
   +1 is an added, -1 a removed record, 0 with a nonzero cell a changed one, and the nonzero cells name the fields.

Both passes group by the record's key, never by the repo, so a repo that holds a third of all rows is spread like any
other, and both combine on the map side.

Defined cases: null or unreadable keys, and keys without rule, file or line, are no records. A null ``findings`` is an
empty snapshot. ``entries`` null, or without an entry for a key, leaves the key present with an unknown state, which
never counts as changed. Copies of an entry inside one snapshot are one; should they differ, the copy that sorts last
as text counts. Of deliveries received at the same moment the one with more keys counts, then the one that sorts last.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.scale import successor

#: The entry fields whose change makes a record changed.
COMPARED = ("category", "severity", "confidence", "status", "title", "end_line", "sources")

KEY_SCHEMA = "rule_id string, file string, line string, symbol string"


def clean_path(path: Column) -> Column:
    """Separators as ``/``, no leading ``./``, doubled separators made one."""
    slashes = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    return F.regexp_replace(slashes, r"^(\./)+", "")


def clean_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def clean_symbol(symbol: Column) -> Column:
    return F.coalesce(F.trim(symbol), F.lit(""))


def latest_deliveries(snapshots: DataFrame) -> DataFrame:
    """One row for each (repo, snapshot_no): the delivery received last."""
    rank = F.struct(
        F.col("received_at"),
        F.coalesce(F.size("findings"), F.lit(-1)).alias("n"),
        F.xxhash64("findings", "entries").alias("h"),
    )
    return (
        snapshots.where(F.col("repo").isNotNull() & F.col("snapshot_no").isNotNull())
        .select("repo", "snapshot_no", F.struct("findings", "entries").alias("body"), rank.alias("rank"))
        .groupBy("repo", "snapshot_no")
        .agg(F.max_by("body", "rank").alias("body"))
        .select("repo", "snapshot_no", "body.findings", "body.entries")
    )


def _state() -> Column:
    sources = F.array_sort(F.array_distinct(F.transform(F.filter("e.sources", lambda s: s.isNotNull()), clean_text)))
    return F.to_json(
        F.struct(
            clean_text(F.col("e.category")).alias("category"),
            clean_text(F.col("e.severity")).alias("severity"),
            F.format_string("%.4f", F.round(F.col("e.confidence"), 4)).alias("confidence"),
            clean_text(F.col("e.status")).alias("status"),
            clean_text(F.col("e.title")).alias("title"),
            F.col("e.end_line").cast("string").alias("end_line"),
            F.concat_ws(",", sources).alias("sources"),
        ),
        {"ignoreNullFields": "false"},
    )


def records(latest: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(repo, snapshot_no, *carry, rule_id, file, start_line, symbol, state) with one row for each record; state is null where the
    snapshot holds no entry for the key. Keys and entries of a snapshot are told apart by one union and one grouping."""
    head = ("repo", "snapshot_no", *carry)
    key = F.from_json("k", KEY_SCHEMA)
    keys = (
        latest.select(*head, F.explode("findings").alias("k"))
        .select(*head, key.alias("k"))
        .select(
            *head,
            F.trim("k.rule_id").alias("rule_id"),
            clean_path(F.col("k.file")).alias("file"),
            F.expr("try_cast(trim(k.line) as int)").alias("start_line"),
            clean_symbol(F.col("k.symbol")).alias("symbol"),
            F.lit(1).alias("named"),
            F.lit(None).cast("string").alias("state"),
        )
    )
    entries = latest.select(*head, F.explode("entries").alias("e")).select(
        *head,
        F.trim("e.rule_id").alias("rule_id"),
        clean_path(F.col("e.file")).alias("file"),
        F.col("e.start_line").alias("start_line"),
        clean_symbol(F.col("e.symbol")).alias("symbol"),
        F.lit(0).alias("named"),
        _state().alias("state"),
    )
    identity = [*head, "rule_id", "file", "start_line", "symbol"]
    return (
        keys.unionByName(entries)
        .where("rule_id is not null and file is not null and start_line is not null")
        .groupBy(*identity)
        .agg(F.max("named").alias("named"), F.max("state").alias("state"))
        .where("named = 1")
        .drop("named")
    )


def signed_states(snapshots: DataFrame) -> DataFrame:
    """Each record once with its own snapshot and once, negated, with the next; the first snapshot of a repo is no target."""
    latest = latest_deliveries(snapshots)
    numbers = snapshots.where("repo is not null and snapshot_no is not null").select("repo", "snapshot_no").distinct()
    order = successor(numbers, "repo", "snapshot_no", "next_no")
    firsts = numbers.groupBy("repo").agg(F.min("snapshot_no").alias("first_no"))
    linked = latest.join(order.join(firsts, "repo"), ["repo", "snapshot_no"])
    rows = records(linked, ("next_no", "first_no"))
    sides = F.array(
        F.struct(F.col("snapshot_no").alias("at"), F.lit(1).alias("sign")),
        F.struct(F.col("next_no").alias("at"), F.lit(-1).alias("sign")),
    )
    return rows.select(
        "repo",
        F.explode(F.filter(sides, lambda s: s["at"].isNotNull() & (s["at"] > F.col("first_no")))).alias("side"),
        "rule_id",
        "file",
        "start_line",
        "symbol",
        "state",
    ).select("repo", F.col("side.at").alias("snapshot_no"), "rule_id", "file", "start_line", "symbol", "state", F.col("side.sign").alias("sign"))


def changes(snapshots: DataFrame) -> DataFrame:
    """(repo, snapshot_no, rule_id, file, start_line, symbol, change_kind, changed_fields)."""
    identity = ["repo", "snapshot_no", "rule_id", "file", "start_line", "symbol"]
    left_over = signed_states(snapshots).groupBy(*identity, "state").agg(F.sum("sign").alias("sign")).where("sign != 0")
    state = F.from_json("state", ", ".join(f"{c} string" for c in COMPARED))
    cells = F.array(
        F.struct(F.lit("").alias("field"), F.lit("").alias("value")),
        F.struct(F.lit("?").alias("field"), F.when(F.col("state").isNull(), "unknown").alias("value")),
        *[F.struct(F.lit(c).alias("field"), F.coalesce(state[c], F.lit("")).alias("value")) for c in COMPARED],
    )
    sums = (
        left_over.withColumn("cell", F.explode(cells))
        .where("cell.value is not null and (state is not null or cell.field in ('', '?'))")
        .groupBy(*identity, "cell")
        .agg(F.sum("sign").alias("sign"))
    )
    by_record = sums.groupBy(*identity).agg(
        F.sum(F.when(F.col("cell.field") == "", F.col("sign"))).alias("presence"),
        F.max(F.when(F.col("cell.field") == "?", F.lit(1)).otherwise(0)).alias("unknown"),
        F.array_sort(
            F.collect_set(F.when((F.col("sign") != 0) & ~F.col("cell.field").isin("", "?"), F.col("cell.field")))
        ).alias("fields"),
    )
    kind = (
        F.when(F.col("presence") > 0, "added")
        .when(F.col("presence") < 0, "removed")
        .when((F.col("unknown") == 0) & (F.size("fields") > 0), "changed")
    )
    return (
        by_record.withColumn("change_kind", kind)
        .where("change_kind is not null")
        .withColumn("changed_fields", F.when(F.col("change_kind") == "changed", F.col("fields")).otherwise(F.array().cast("array<string>")))
        .select(*identity, "change_kind", "changed_fields")
    )
