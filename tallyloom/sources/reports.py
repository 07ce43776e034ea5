"""Tool reports as raw findings: (provider, rule_id, message, file, start_line, end_line, severity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities by tool vocabulary.
PRIORITY = {"1": "HIGH", "2": "HIGH", "3": "MEDIUM", "4": "LOW", "5": "LOW"}
RANK = {"1": "HIGH", "2": "MEDIUM", "3": "LOW"}
LEVEL = {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "LOW"}
#: Duplicated blocks of this many tokens are severe.
LONG_COPY = 300
#: Issue buckets of the unused-code report.
BUCKETS = ("dependencies", "devDependencies", "exports", "types", "unlisted", "unresolved", "binaries", "duplicates", "enumMembers", "files")


def _of(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _row(provider: str, rule: Column, message: Column, file: Column, start: Column, end: Column, severity: Column) -> list[Column]:
    return [F.lit(provider).alias("provider"), rule.alias("rule_id"), message.alias("message"), file.alias("file"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), severity.alias("severity")]


def pmd(payloads: DataFrame, column: str) -> DataFrame:
    schema = "file array<struct<_name:string,violation:array<struct<_beginline:int,_endline:int,_rule:string,_priority:string,_VALUE:string>>>>"
    files = payloads.select(F.explode(F.from_xml(F.col(column), schema)["file"]).alias("f")).select("f._name", F.explode("f.violation").alias("v"))
    return files.select(*_row("pmd", F.col("v._rule"), F.trim("v._VALUE"), F.col("_name"), F.col("v._beginline"), F.col("v._endline"), F.coalesce(_of(PRIORITY, F.col("v._priority")), F.lit("LOW"))))


def cpd(payloads: DataFrame, column: str) -> DataFrame:
    schema = "duplication array<struct<_lines:int,_tokens:int,file:array<struct<_line:int,_path:string>>>>"
    d = payloads.select(F.explode(F.from_xml(F.col(column), schema)["duplication"]).alias("d")).select("d._lines", "d._tokens", F.posexplode("d.file").alias("at", "f"))
    severity = F.when(F.col("_tokens") >= LONG_COPY, "HIGH").otherwise("MEDIUM")
    return d.select(*_row("cpd", F.lit("DUPLICATION"), F.concat(F.col("_tokens").cast("string"), F.lit(" tokens copied")), F.col("f._path"), F.col("f._line"), F.col("f._line") + F.col("_lines") - 1, severity))


def spotbugs(payloads: DataFrame, column: str) -> DataFrame:
    schema = "BugInstance array<struct<_type:string,_priority:string,LongMessage:string,SourceLine:struct<_sourcepath:string,_start:int,_end:int>>>"
    b = payloads.select(F.explode(F.from_xml(F.col(column), schema)["BugInstance"]).alias("b"))
    return b.select(*_row("spotbugs", F.col("b._type"), F.col("b.LongMessage"), F.col("b.SourceLine._sourcepath"), F.col("b.SourceLine._start"), F.col("b.SourceLine._end"), F.coalesce(_of(RANK, F.col("b._priority")), F.lit("LOW"))))


def semgrep(payloads: DataFrame, column: str) -> DataFrame:
    schema = "results array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,extra:struct<message:string,severity:string>>>"
    r = payloads.select(F.explode(F.from_json(column, schema)["results"]).alias("r"))
    return r.select(*_row("semgrep", F.element_at(F.split("r.check_id", r"\."), -1), F.col("r.extra.message"), F.col("r.path"), F.col("r.start.line"), F.col("r.end.line"), F.coalesce(_of(LEVEL, F.col("r.extra.severity")), F.lit("LOW"))))


def knip(payloads: DataFrame, column: str) -> DataFrame:
    item = "array<struct<name:string,line:int>>"
    fields = ", ".join(f"{b}:{item}" for b in BUCKETS if b != "files")
    parsed = payloads.select(F.from_json(column, f"files array<string>, issues array<struct<file:string, {fields}>>").alias("p"))
    cells = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"i.{b}").alias("items")) for b in BUCKETS if b != "files"])
    issues = parsed.select(F.explode("p.issues").alias("i")).select("i.file", F.explode(cells).alias("c")).select("file", "c.bucket", F.explode("c.items").alias("x"))
    rows = issues.select(*_row("knip", F.concat(F.lit("unused-"), F.col("bucket")), F.col("x.name"), F.col("file"), F.coalesce("x.line", F.lit(1)), F.coalesce("x.line", F.lit(1)), F.lit("LOW")))
    files = parsed.select(F.explode("p.files").alias("f")).select(*_row("knip", F.lit("unused-files"), F.col("f"), F.col("f"), F.lit(1), F.lit(1), F.lit("LOW")))
    return rows.unionByName(files)


def javac(lines: DataFrame, column: str) -> DataFrame:
    pattern = r"^(.+?\.java):(\d+): (error|warning): (.*)$"
    part = lambda i: F.regexp_extract(column, pattern, i)
    severity = F.when(part(3) == "error", "HIGH").otherwise("LOW")
    return lines.where(F.col(column).rlike(pattern)).select(*_row("javac", F.concat(F.lit("javac-"), part(3)), part(4), part(1), part(2), part(2), severity))
