"""Operators on findings: cleaning, ranks, filters with reasons, scores, baselines, ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.joins import in_intervals

#: Severity order, score weights of the dimensions, categories of each dimension, share taken by severity.
SEVERITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
DIMENSION_WEIGHT = {"structure": 30.0, "safety": 40.0, "noise": 30.0}
DIMENSION_OF = {
    "COMPLEXITY": "structure", "LARGE_CLASS": "structure", "LARGE_METHOD": "structure", "OVER_ENGINEERING": "structure", "WRONG_ABSTRACTION": "structure", "TESTABILITY": "structure",
    "CONCURRENCY": "safety", "DATABASE": "safety", "ERROR_HANDLING": "safety", "PERFORMANCE": "safety", "RESOURCE_SAFETY": "safety",
    "BOILERPLATE": "noise", "CONFIG_INFLATION": "noise", "DEAD_CODE": "noise", "DEFENSIVE_JUNK": "noise", "DUPLICATION": "noise",
}
SEVERITY_SHARE = {"LOW": 0.02, "MEDIUM": 0.06, "HIGH": 0.2, "CRITICAL": 0.5}
CLOSED = ("ACCEPTED_RISK", "FIXED", "VALIDATED")
#: Languages by file extension.
LANGUAGE_OF = {"java": "java", "vue": "vue", "py": "python", "js": "javascript", "ts": "typescript", "xml": "xml", "sql": "sql", "yml": "yaml", "md": "markdown"}


def lookup(table: dict, key: Column) -> Column:
    """Constant lookup; null for an unknown or null key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def severity(column: str = "severity") -> Column:
    up = F.upper(F.trim(F.col(column)))
    return F.when(up.isin(*SEVERITY_RANK), up)


def strip_all(path: Column) -> Column:
    """Strips all leading dots and slashes."""
    return F.regexp_replace(path, r"^[./]+", "")


def strip_current(path: Column) -> Column:
    """Strips leading ``./`` only."""
    return F.regexp_replace(path, r"^(\./)+", "")


def latest(findings: DataFrame) -> DataFrame:
    """One row for each id: the one received last."""
    others = [c for c in findings.columns if c != "id"]
    ordered = ["received_at", *[c for c in others if c != "received_at"]]
    return findings.where("id is not null").groupBy("id").agg(F.max(F.struct(*ordered)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in others])


def clean(findings: DataFrame) -> DataFrame:
    """Deduplicated findings with a normalised path, severity and rank."""
    sev = severity()
    return latest(findings).withColumn("file", strip_current(F.regexp_replace("file", r"\\", "/"))).withColumn("severity", sev).withColumn("rank", lookup(SEVERITY_RANK, F.col("severity")))


def severity_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY_RANK], F.max("rank").alias("worst_rank"))


def dimension_scores(rows: DataFrame) -> DataFrame:
    """(dimension, used, points): every dimension, also one without findings. Amounts are summed on the map side."""
    spark = rows.sparkSession
    dims = spark.createDataFrame(list(DIMENSION_WEIGHT.items()), "dimension string, weight double")
    amount = lookup(DIMENSION_WEIGHT, F.col("dimension")) * F.coalesce(lookup(SEVERITY_SHARE, F.col("severity")), F.lit(0.0)) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score_weight"))) / 1000
    used = rows.withColumn("dimension", lookup(DIMENSION_OF, F.col("category"))).where("dimension is not null").groupBy("dimension").agg(F.round(F.sum(amount), 4).alias("used"))
    joined = F.broadcast(dims).join(used, "dimension", "left")  # three rows
    return joined.select("dimension", F.coalesce("used", F.lit(0.0)).alias("used"), F.greatest(F.lit(0.0), F.round(F.col("weight") - F.coalesce("used", F.lit(0.0)), 4)).alias("points"))


def drop_reasons(rows: DataFrame, excluded: Sequence[str], changed: DataFrame) -> DataFrame:
    """Adds ``reason``: why a finding is dropped (excluded path, outside the change), or null."""
    segments = F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(x) for x in excluded]))
    marked = rows.join(changed.select("file").distinct().withColumn("touched", F.lit(True)), "file", "left")
    return marked.withColumn("reason", F.when(segments, "excluded_path").when(F.col("touched").isNull(), "outside_change")).drop("touched")


def hunk_reasons(rows: DataFrame, excluded: Sequence[str], changed: DataFrame, hunks: DataFrame) -> DataFrame:
    """As :func:`drop_reasons`, and ``outside_hunk`` for a finding whose line is in no hunk (file, low, high) of its file; a
    changed file without hunks counts as changed as a whole. ``rows`` has unique ids."""
    marked = drop_reasons(rows, excluded, changed)
    cut = hunks.select("file").distinct().withColumn("_cut", F.lit(True))
    inside = in_intervals(rows.select("id", "file", "start_line"), hunks, "file", "start_line").select("id").distinct().withColumn("_in", F.lit(True))
    both = marked.join(cut, "file", "left").join(inside, "id", "left")
    return both.withColumn("reason", F.coalesce("reason", F.when(F.col("_cut") & F.col("_in").isNull(), "outside_hunk"))).drop("_cut", "_in")


def handoff(fields: Column, schemas: dict[str, dict]) -> Column:
    """(kind, issues) of a map of fields: the first schema all of whose ``marks`` are there, with the required fields that
    are missing or empty and the fields whose value is none of the allowed ones; no schema fits: kind null, one issue."""
    keys = F.map_keys(fields)
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.array(F.lit("unknown kind")).alias("issues"))
    for name, schema in reversed(list(schemas.items())):
        fits = F.size(F.array_except(F.array(*[F.lit(m) for m in schema["marks"]]), keys)) == 0
        value = lambda f: F.try_element_at(fields, F.lit(f))
        issues = [F.when(F.coalesce(value(f), F.lit("")) == "", F.lit(f"missing {f}")) for f in schema.get("required", ())]
        issues += [F.when((F.coalesce(value(f), F.lit("")) != "") & ~value(f).isin(*allowed), F.lit(f"not allowed {f}")) for f, allowed in schema.get("allowed", {}).items()]
        out = F.when(fits, F.struct(F.lit(name).alias("kind"), F.array_compact(F.array(*issues)).cast("array<string>").alias("issues"))).otherwise(out)
    return out


def glob_to_regex(pattern: str) -> str:
    """A glob with ``**``, ``*`` and ``?`` as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        elif pattern[i] == "?":
            out.append("[^/]")
            i += 1
        else:
            out.append("\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] not in "/_" else pattern[i])
            i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, patterns: Sequence[str]) -> Column:
    """Glob match of the whole path, or of the bare file name for a pattern without a slash."""
    out = F.lit(False)
    name = F.element_at(F.split(path, "/"), -1)
    for p in patterns:
        out = out | (path if "/" in p else name).rlike(glob_to_regex(p))
    return out


def report_order(rows: DataFrame) -> DataFrame:
    """Adds ``place`` within each file: severity first, then position and id. Files keep the window parallel."""
    w = Window.partitionBy("file").orderBy(F.desc_nulls_last("rank"), "start_line", F.asc_nulls_last("end_line"), "id")
    return rows.withColumn("place", F.row_number().over(w))


def top_findings(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of the report; Spark keeps n rows a partition (TakeOrderedAndProject)."""
    return rows.orderBy(F.desc_nulls_last("rank"), F.desc_nulls_last("confidence"), "id").limit(n)


def conflicts(rows: DataFrame) -> DataFrame:
    """Places (file, line) told with two or more severities of which the worst is HIGH or above."""
    return rows.groupBy("file", "start_line").agg(F.count_distinct("severity").alias("severities"), F.max("rank").alias("worst"), F.count(F.lit(1)).alias("n")).where("severities >= 2 and worst >= 2")


def violations(rows: DataFrame) -> DataFrame:
    """(id, code) for every schema rule a finding breaks."""
    rules = [
        ("SCHEMA-001", F.col("severity").isNull()),
        ("SCHEMA-002", ~F.coalesce((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.lit(False))),
        ("SCHEMA-003", F.coalesce(F.col("end_line") < F.col("start_line"), F.lit(True))),
        ("SCHEMA-004", F.coalesce(F.size("sources"), F.lit(0)) <= 0),
        ("SCHEMA-005", F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0),
    ]
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(broken, code) for code, broken in rules]))).alias("code"))


def baseline_metrics(rows: DataFrame) -> DataFrame:
    """Six numbers of one state."""
    return rows.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("category").isin("COMPLEXITY", "LARGE_METHOD", "LARGE_CLASS")).alias("complexity"),
        F.count_if(F.col("category") == "DUPLICATION").alias("duplication"),
        F.count_if(F.col("category") == "DEAD_CODE").alias("dead_code"),
        F.count_if(F.col("rank") >= 2).alias("severe"),
        F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def tree_hash(files: DataFrame, path: str, content: str) -> DataFrame:
    """(tree_hash, files): SHA-256 of the sorted directory:hash lines, a directory's hash being that of its sorted path:hash
    lines. What comes together is one directory's files, then one line a directory."""
    lines = files.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("d"), F.concat(path, F.lit(":"), F.col(content).cast("string")).alias("l"))
    dirs = lines.groupBy("d").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return dirs.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("d", F.lit(":"), "h"))), "\n"), 256).alias("tree_hash"), F.sum("n").alias("files"))
