"""Unified diffs and name-status lists as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK_SCHEMA = "path string, old_path string, change_kind string, hunk int, old_start int, old_count int, new_start int, new_count int, lines array<string>, numbers array<int>"
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> list[tuple]:
    """(path, old_path, change_kind, hunk, old_start, old_count, new_start, new_count, lines, numbers); a file without hunks has one row with hunk 0.
    ``numbers`` holds the line in the new file for each line, null for a deleted one."""
    out: list[tuple] = []
    path = old = kind = None
    hunks = 0
    current: list | None = None
    left_old = left_new = 0

    def close() -> None:
        nonlocal current
        if current is not None:
            at, numbers = current[3], []
            for line in current[-1]:
                numbers.append(None if line.startswith("-") else at)
                at += not line.startswith("-")
            out.append((path, old, kind, *current, numbers))
            current = None

    def end_file() -> None:
        close()
        if path is not None and not hunks:
            out.append((path, old, kind, 0, None, None, None, None, [], []))

    for line in text.splitlines():
        if current is not None and (left_old > 0 or left_new > 0):
            mark = line[:1]
            if mark in "+- " or not line:
                current[-1].append(line or " ")
                left_old -= mark != "+"
                left_new -= mark != "-"
                continue
            if mark == "\\":
                continue
        if line.startswith("diff --git "):
            end_file()
            m = re.match(r"diff --git a/(.*) b/(.*)$", line)
            old, path, kind, hunks = (m.group(1), m.group(2), "M", 0) if m else (None, line[11:], "M", 0)
        elif line.startswith("new file"):
            kind = "A"
        elif line.startswith("deleted file"):
            kind = "D"
        elif line.startswith("rename from "):
            old, kind = line[12:], "R"
        elif line.startswith("rename to "):
            path = line[10:]
        elif m := _HUNK.match(line):
            close()
            hunks += 1
            a, b, c, d = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            current, left_old, left_new = [hunks, a, b, c, d, []], b, d
        elif line.startswith("\\"):
            continue
    end_file()
    return out


def read_diffs(texts: DataFrame, text: str) -> DataFrame:
    """Hunks of every diff text, one row a hunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HUNK_SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for t in batch["t"] for r in parse_diff(t or "")], columns=names)

    return texts.select(F.col(text).alias("t")).mapInPandas(run, HUNK_SCHEMA)


def added_lines(hunks: DataFrame) -> DataFrame:
    """(path, line_no, text) of added lines, numbered in the new file."""
    flat = hunks.select("path", F.explode(F.arrays_zip("lines", "numbers")).alias("l"))
    return flat.where(F.col("l.lines").startswith("+")).select("path", F.col("l.numbers").alias("line_no"), F.expr("substr(l.lines, 2)").alias("text"))


def name_status(lines: DataFrame, column: str) -> DataFrame:
    """(kind, path, old_path) of ``A``/``M``/``D``/``Rnn``/``Cnn`` lines."""
    parts = F.split(column, "\t")
    kind = F.substring(parts[0], 1, 1)
    moved = kind.isin("R", "C")
    return lines.where(F.col(column).rlike(r"^[AMDRC]\d*\t")).select(kind.alias("kind"), F.when(moved, F.try_element_at(parts, F.lit(3))).otherwise(parts[1]).alias("path"), F.when(moved, parts[1]).alias("old_path"))
