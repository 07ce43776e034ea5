"""Facts of code by patterns inside the JVM: symbols, string literals, statements, conditions, and what they tell over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.descriptions import negative_clause
from tallyloom.functions.text import lines, strip_space, token_estimate, word_count

#: Declarations by language and kind; the name is the first group.
SYMBOLS = (
    ("java", "class", r"\b(?:class|interface|enum|record)\s+([A-Z][A-Za-z0-9_]*)"),
    ("java", "method", r"\b(?:public|protected|private)\s+(?:static\s+|final\s+|abstract\s+)*[A-Za-z0-9_<>\[\], ?]+\s+([a-z][A-Za-z0-9_]*)\s*\("),
    ("python", "method", r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ("python", "class", r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\s*[(:]"),
    ("javascript", "method", r"\b(?:function|const|let)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*(?:=\s*(?:async\s*)?)?\("),
    ("javascript", "component", r"\bname:\s*[\"']([A-Z][A-Za-z0-9]*)[\"']"),
    ("xml", "statement", r"<(?:select|insert|update|delete)\s+id=\"([A-Za-z0-9_]+)\""),
)
#: Texts of string literals.
LITERAL = r'"((?:\\.|[^"\\\n])*)"'
UPDATE, DELETE, WHERE = r"(?is)^\s*update\s+\S+\s+set\b", r"(?is)^\s*delete\s+from\b", r"(?i)\bwhere\b"


def symbols(files: DataFrame, key: str, code: str) -> DataFrame:
    """(key, language, kind, name): each declaration that a pattern finds."""

    def found(language: str, kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all(F.coalesce(F.col(code), F.lit("")), F.lit(pattern), F.lit(1))
        return F.transform(names, lambda n: F.struct(F.lit(language).alias("language"), F.lit(kind).alias("kind"), n.alias("name")))

    cells = [found(*s) for s in SYMBOLS]
    return files.select(key, F.explode(F.concat(*cells)).alias("s")).select(key, "s.*")


def symbol_stats(found: DataFrame) -> DataFrame:
    """Declarations and distinct names by language, by kind and by both in one pass."""
    sets = found.groupingSets([["language"], ["kind"], ["language", "kind"]], "language", "kind")
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


def literals(code: Column) -> Column:
    """The distinct texts of string literals, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(LITERAL), F.lit(1))))


def open_statements(rows: DataFrame, key: str, literal: str) -> DataFrame:
    """(key, rule, literal): statements that change all rows of a table. Texts put together at run time are left out."""
    sql = F.col(literal)
    rule = F.when(sql.rlike(UPDATE), "UPDATE-NO-WHERE").when(sql.rlike(DELETE), "DELETE-NO-WHERE")
    return rows.select(key, rule.alias("rule"), literal).where(F.col("rule").isNotNull() & ~F.col(literal).rlike(WHERE) & ~F.contains(literal, F.lit("${")))


def mapper_statements(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, id, literal) of the update and delete statements of mapper files; a ``<where>`` part reads as a where clause."""
    whole = F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit(r"(?s)<(?:update|delete)\s+id=\"[^\"]+\".*?</(?:update|delete)>"), F.lit(0))
    flat = rows.select(key, F.explode(whole).alias("_s"))
    body = F.regexp_replace(F.regexp_replace(F.col("_s"), r"(?s)^<(?:update|delete)[^>]*>|</(?:update|delete)>$", ""), r"<where>", " where ")
    return flat.select(key, F.regexp_extract("_s", 'id="([^"]+)"', 1).alias("id"), strip_space(F.regexp_replace(body, r"<[^>]+>", " ")).alias("literal"))


def shared_texts(rows: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(text, files, first): normalised texts that stand in ``least`` or more files, one row a text; a file counts once."""
    return rows.select(key, text).where(F.col(text) != "").distinct().groupBy(text).agg(F.count(F.lit(1)).alias("files"), F.min(key).alias("first")).where(F.col("files") >= least)


def calls(files: DataFrame, key: str, code: str, declared: DataFrame) -> DataFrame:
    """(name, callers, calls) of declared names: files and places that call them, none for those nobody calls."""
    flat = files.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(code), F.lit("")), F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))).alias("name"))
    per = flat.groupBy("name", key).agg(F.count(F.lit(1)).alias("c")).groupBy("name").agg(F.count(F.lit(1)).alias("callers"), F.sum("c").alias("calls"))
    return declared.select("name").distinct().join(per, "name", "left").select("name", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("calls", F.lit(0)).alias("calls"))


#: What makes a declaration reachable without a call: kind and a pattern whose first group is the name, "" for the next one.
ENTRIES = (
    ("reflection", r"\b(?:forName|loadClass|getBean|getMethod|getDeclaredMethod)\(\s*\"(?:[A-Za-z0-9_.]*\.)?([A-Za-z_][A-Za-z0-9_]*)\""),
    ("container", r"@(?:Component|Service|Repository|Controller|RestController|Configuration|Bean|Scheduled|EventListener)\b[^{;]*?\b(?:class\s+|[A-Za-z_][A-Za-z0-9_<>]*\s+)([A-Za-z_][A-Za-z0-9_]*)\s*[({]"),
    ("listener", r"@(?:KafkaListener|RabbitListener|JmsListener)\b[^{;]*?\s([A-Za-z_][A-Za-z0-9_]*)\s*\("),
    ("descriptor", r"\b(?:class|ref)=\"(?:[A-Za-z0-9_.]*\.)?([A-Za-z_][A-Za-z0-9_]*)\""),
    ("import", r"\bimport\(\s*['\"](?:[^'\"]*/)?([A-Za-z_][A-Za-z0-9_]*)(?:\.[a-z]+)?['\"]"),
)


def dynamic_entries(files: DataFrame, key: str, code: str) -> DataFrame:
    """(key, kind, name): names that a text makes reachable by reflection, a container, a listener, a descriptor or an import
    at run time; declarations with such a name are not unused for want of a call."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(F.col(code), F.lit("")), F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    return files.select(key, F.explode(F.array_distinct(F.concat(*[found(*e) for e in ENTRIES]))).alias("e")).select(key, "e.*")


#: Sizes of a guiding text from which it should be split or loaded on demand.
MOST_LINES, MOST_WORDS, MOST_TOKENS = 400, 1200, 2000


def guide_rules(text: Column, description: Column) -> Column:
    """What an audit finds in a guiding text: too long in lines, words or tokens, no heading, no or a short description, no
    clause of what it is not for."""
    t = F.coalesce(text, F.lit(""))
    d = F.coalesce(description, F.lit(""))
    rules = (
        ("lines", F.size(lines(t)) > MOST_LINES), ("words", word_count(t) > MOST_WORDS), ("tokens", token_estimate(t) > MOST_TOKENS), ("no heading", ~t.rlike(r"(?m)^#{1,6}\s")),
        ("no description", F.length(F.trim(d)) == 0), ("short description", F.length(F.trim(d)).between(1, 19)), ("no exclusions", (F.length(F.trim(d)) > 0) & (negative_clause(d) == "")),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def guide_verdict(rules: Column) -> Column:
    """SPLIT for what is too long, OPTIMIZE for what is only badly described, else KEEP."""
    return F.when(F.arrays_overlap(rules, F.array(F.lit("lines"), F.lit("words"), F.lit("tokens"))), "SPLIT").when(F.size(rules) > 0, "OPTIMIZE").otherwise("KEEP")
