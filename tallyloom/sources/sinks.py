"""Writers: deterministic JSON report, SARIF, JSON lines, numbered snapshots."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.redaction import COUNTERS, MASK, SENSITIVE_KEYS, masked_values

#: SARIF levels by severity.
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}


def json_rows(rows: DataFrame, columns: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """One JSON text for each row, fields in the given order, nulls kept; ``keep`` names columns to stand beside it."""
    return rows.select(*keep, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown_rows(rows: DataFrame, columns: list[str], keys: Sequence[str]) -> DataFrame:
    """(part, *keys, line) of a table in Markdown: part 0 the head, 1 the rule, 2 the rows, to be ordered by part and keys. Bars
    in cells are escaped, line breaks become spaces, null is an empty cell. Lines are rows, so a report of any size is
    written in parallel."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s*[\r\n]+\s*", " "), F.lit("|"), F.lit("\\|"))
    body = rows.select(F.lit(2).alias("part"), *keys, F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "part int, line string")
    return head.unionByName(body, allowMissingColumns=True)


def checked_lines(rows: DataFrame, required: Sequence[str], columns: list[str], keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, missing, json): what an append-only log takes: rows with all required fields as JSON, values masked by key and by
    shape; for the others the fields they lack and no text."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    shown = [(F.lit(MASK) if re.search(SENSITIVE_KEYS, c) and c not in COUNTERS else masked_values(F.col(c).cast("string"))).alias(c) for c in columns]
    return rows.select(*keep, missing.alias("missing"), F.when(F.size(missing) == 0, F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})).alias("json"))


def sarif_results(rows: DataFrame) -> DataFrame:
    """(json): one SARIF result for each finding. Results are rows, so a report of any size is written in parallel."""
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SARIF_LEVEL.items() for x in p]), F.col("severity")), F.lit("none"))
    region = F.struct(F.col("start_line").alias("startLine"), F.greatest("start_line", F.coalesce("end_line", "start_line")).alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return rows.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("title", F.lit("")).alias("text")).alias("message"), F.array(place).alias("locations"))).alias("json"))


def sarif_rules(rows: DataFrame) -> DataFrame:
    """(rule_id, name): each rule once."""
    return rows.groupBy("rule_id").agg(F.min("category").alias("name"))


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends JSON lines; :func:`checked_lines` is what should go in."""
    rows.write.mode("append").json(path)


def write_snapshot(rows: DataFrame, path: str, number: int) -> None:
    """One numbered snapshot beside the earlier ones."""
    rows.withColumn("seq", F.lit(number)).write.mode("append").partitionBy("seq").json(path)
