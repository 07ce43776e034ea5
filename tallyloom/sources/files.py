"""Files of a folder as rows: walk, whole texts, binary sniff, ledgers, small YAML."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that are looked at to tell a binary file, and the least share of printable ones in a text.
SNIFFED, PRINTABLE = 4096, 0.7


def walk(spark: SparkSession, folder: str, suffixes: Sequence[str] = (), excluded: Sequence[str] = (), most_bytes: int | None = None) -> DataFrame:
    """(path, name, length, content) of the files below a folder: with one of the suffixes, no path segment among the
    excluded ones, at most so many bytes. The size is checked before a file is opened; ``content`` is read only if used. Empty
    files give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    if excluded:
        files = files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in excluded])))
    if suffixes:
        files = files.where(F.col("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "content")


def is_binary(content: Column) -> Column:
    """Whether the first bytes hold a NUL or too few printable ones; an empty file is a text."""
    digits = F.hex(F.substring(content, 1, SNIFFED))
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))
    odd = F.size(F.filter(pairs, lambda p: p.rlike("^(?:0[0-8BCEF]|1[0-9A-F]|7F)$")))
    return F.when(F.size(pairs) == 0, False).otherwise(F.array_contains(pairs, "00") | (odd > (1 - PRINTABLE) * F.size(pairs)))


def texts(files: DataFrame) -> DataFrame:
    """(path, name, text) of the files that are no binaries; bytes that are no UTF-8 become replacement signs."""
    return files.where(~is_binary(F.col("content"))).select("path", "name", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_ledgers(spark: SparkSession, folder: str, globs: Sequence[str] = ("*.json",)) -> DataFrame:
    """(file, ledger fields, skipped): run ledgers, one JSON object a file; files that are not JSON or have no run id are
    ``skipped``."""
    schema = "run_id string, repo string, mode string, duration_ms bigint, llm_calls int, gate string, _bad string"
    rows = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(globs) + "}").json(folder)
    named = rows.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), "*")
    return named.withColumn("skipped", F.col("_bad").isNotNull() | F.col("run_id").isNull()).drop("_bad")


def _scalar(text: str):
    s = text.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        return s[1:-1]
    s = re.split(r"\s+#", s, maxsplit=1)[0].strip()
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", s[1:-1])]
    known = {"": None, "~": None, "null": None, "true": True, "false": False}
    if s.lower() in known:
        return known[s.lower()]
    return int(s) if re.fullmatch(r"-?\d+", s) else float(s) if re.fullmatch(r"-?\d+\.\d+", s) else s


def parse_yaml(text: str) -> list[tuple[str, str]]:
    """(path, value) of every leaf of block maps, block lists and inline lists; paths are joined by points, list places
    are numbers. What is none of these is left out; a later key of the same path counts."""
    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []
    counts: dict[str, int] = {}

    def put(path: str, value) -> None:
        if isinstance(value, list):
            for i, v in enumerate(value):
                put(f"{path}.{i}", v)
        elif value is not None:
            out[path] = str(value).lower() if isinstance(value, bool) else str(value)

    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        indent = len(line) - len(line.lstrip(" "))
        body = line.strip()
        while stack and stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent and stack[-1][1][-1:] != "]"):
            stack.pop()
        above = stack[-1][1].rstrip("]") if stack else ""
        while body.startswith("- "):
            at = counts.get(above, 0)
            counts[above] = at + 1
            above = f"{above}.{at}" if above else str(at)
            stack.append((indent, above + "]"))
            body, indent = body[2:].strip(), indent + 2
        m = re.match(r"([A-Za-z0-9_.\-/]+|\"[^\"]+\"):(?:\s+(.*))?$", body)
        if m:
            path = f"{above}.{m.group(1).strip(chr(34))}" if above else m.group(1).strip('"')
            if m.group(2) and not m.group(2).startswith("#"):
                put(path, _scalar(m.group(2)))
            else:
                stack.append((indent, path))
        elif above:
            put(above, _scalar(body))
    return list(out.items())


def read_yaml(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): the leaves of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flat = [(k, p, v) for k, t in zip(batch["key"], batch["text"], strict=True) for p, v in parse_yaml(t or "")]
            yield pd.DataFrame(flat, columns=["key", "path", "value"])

    types = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, types)
