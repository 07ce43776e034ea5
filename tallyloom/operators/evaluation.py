"""Scores of texts against the checks of their case, and summaries of judges' marks.

A text is scored in eight dimensions of 0 to 100, all as Column expressions: filler, accuracy, fidelity, preserve,
brevity, adapt, discipline, stick. Checks come from a struct of the case; a check that is null is not made. Patterns of
a case are read for each row. Null texts are scored as empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as fx

#: Weights of the dimensions, of the judges' marks, and the words that show a required field.
WEIGHTS = {"filler": 2.0, "accuracy": 2.5, "fidelity": 2.0, "preserve": 1.5, "brevity": 1.5, "adapt": 1.5, "discipline": 1.0, "stick": 1.5}
MARKS = {"correctness": 0.30, "actionability": 0.20, "concision": 0.25, "autonomy": 0.15, "safety": 0.10}
FIELD_WORDS = {
    "decision": "decision|决策|决定|结论|建议|改用|采用",
    "constraint": "constraint|约束|限制|前提|必须",
    "evidence": "evidence|证据|依据|实测|日志|复现",
    "risk": "risk|风险|回滚|隐患|代价|副作用",
    "verification": "verification|验证|自测|测试|复跑",
}
#: What a text must reach of the least length, and in the other dimensions to count as sticky.
FLOOR = 0.6
STICKY = {"filler": 100.0, "accuracy": 80.0, "adapt": 80.0, "preserve": 60.0, "fidelity": 80.0}


def sentence_count(text: Column) -> Column:
    """Terminators, or non-blank lines if there are more of them."""
    return F.greatest(F.regexp_count(text, F.lit(r"[。！？!?]|\.\s")), F.size(fx.full_lines(text)))


def within(n: Column, most: Column) -> Column:
    """1 up to the budget, then the budget's share; null without a budget."""
    return F.when(most.isNotNull(), F.when(n <= most, F.lit(1.0)).otherwise(most / F.greatest(n, F.lit(1))))


def least_of(parts: Sequence[Column]) -> Column:
    """100 times the least part that is not null, 100 without parts."""
    return 100.0 * F.coalesce(F.least(*parts, F.lit(None).cast("double")), F.lit(1.0))


def share_found(patterns: Column, text: Column) -> Column:
    """Share of patterns that the text holds; 1 without patterns. Null and empty lists are none."""
    kept = F.filter(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: p.isNotNull())
    return F.when(F.size(kept) > 0, F.size(F.filter(kept, lambda p: F.regexp_like(text, F.concat(F.lit("(?m)"), p)))) / F.size(kept)).otherwise(1.0)


def has_field(name: Column, text: Column) -> Column:
    out = F.lit(False)
    for field, words in FIELD_WORDS.items():
        out = F.when(name == field, text.rlike(words)).otherwise(out)
    return out


def discipline(text: Column) -> Column:
    """Share of five checks of form that pass: blank runs, repeated lines, skipped heading levels, blanks at line ends, a
    decoration at the end."""
    full = F.transform(fx.full_lines(text), lambda x: fx.strip_space(x))
    long = F.filter(full, lambda x: F.length(x) >= 12)
    levels = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s"), F.lit(1)), lambda x: F.length(x))
    jumps = F.exists(F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: b > a + 1), lambda x: F.coalesce(x, F.lit(False)))
    checks = [
        ~text.rlike(r"\n[ \t]*\n[ \t]*\n"),
        F.size(long) == F.size(F.array_distinct(long)),
        ~jumps,
        ~text.rlike(r"(?m)[ \t]+$"),
        ~F.coalesce(F.try_element_at(full, F.lit(-1)).rlike(r"^[-—=*_]{3,}$"), F.lit(False)),
    ]
    return 100.0 * sum((c.cast("int") for c in checks), F.lit(0)) / len(checks)


def dimensions(text: Column, check: Column, sticky: Column, filler: Sequence[str]) -> dict[str, Column]:
    """The eight dimensions. ``check`` has max_chars, max_sentences, min_chars, must_regex, require_fields, must_numbers."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    hits = F.lit(False)
    for p in filler:
        hits = hits | t.rlike("(?m)" + p)
    wanted = F.filter(F.coalesce(check["require_fields"], F.array().cast("array<string>")), lambda f: f.isNotNull())
    floor = check["min_chars"] * FLOOR
    shapes = [
        F.when(check["min_chars"].isNotNull(), F.least(F.lit(1.0), n / F.greatest(check["min_chars"], F.lit(1)))),
        F.when(F.coalesce(check["must_numbers"], F.lit(False)), t.rlike("[0-9]").cast("double")),
    ]
    asked = sum((s.isNotNull().cast("int") for s in shapes), F.lit(0))
    out = {
        "filler": F.when(hits, 0.0).otherwise(100.0),
        "accuracy": 100.0 * share_found(check["must_regex"], t),
        "fidelity": F.when(check["min_chars"].isNotNull(), 100.0 * F.least(F.lit(1.0), n / floor)).otherwise(100.0),
        "preserve": F.when(F.size(wanted) > 0, 100.0 * F.size(F.filter(wanted, lambda f: has_field(f, t))) / F.size(wanted)).otherwise(100.0),
        "brevity": least_of([within(n, check["max_chars"]), within(sentence_count(t), check["max_sentences"])]),
        "adapt": F.when(asked > 0, 100.0 * sum((F.coalesce(s, F.lit(0.0)) for s in shapes), F.lit(0.0)) / asked).otherwise(100.0),
        "discipline": discipline(t),
    }
    held = F.lit(True)
    for name, least in STICKY.items():
        held = held & (out[name] >= least)
    return out | {"stick": F.when(F.coalesce(sticky, F.lit(False)) & ~held, 0.0).otherwise(100.0)}


def scored(rows: DataFrame, filler: Sequence[str]) -> DataFrame:
    """``rows`` (text, check, sticky, ...) with the eight dimensions, rounded to four places, and ``total``."""
    dims = dimensions(F.col("text"), F.col("check"), F.col("sticky"), filler)
    out = rows.withColumns({name: F.round(c, 4) for name, c in dims.items()})
    return out.withColumn("total", F.round(sum((F.col(name) * w for name, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values()), 1))


def score_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the total and of each dimension, number of texts, share of sticky ones that held."""
    sticky = F.coalesce("sticky", F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 4).alias("total"), *[F.round(F.avg(name), 4).alias(name) for name in WEIGHTS],
        F.round(F.avg(F.when(sticky, (F.col("stick") >= 100).cast("int"))), 6).alias("sticky_rate"),
    ).drop("stick")


def probe_rate(rows: DataFrame, probe: str, expected: str) -> DataFrame:
    """Of the texts planted to fail (``probe`` equals ``expected``), by any dimension: how many score below 100 somewhere."""
    failed = F.least(*[F.col(name) for name in WEIGHTS]) < 100
    return rows.where(F.col(probe).isNotNull()).groupBy(F.col(probe).alias("probe")).agg(
        F.count(F.lit(1)).alias("planted"), F.count_if(failed).alias("failed"), F.round(F.count_if(failed == (F.col(probe) == expected)) / F.count(F.lit(1)), 6).alias("as_expected")
    )


def read_judges(lines: DataFrame, column: str) -> DataFrame:
    """(bad, case_id, label, marks..., blocker, notes): judges' lines as JSON; a bad line has ``bad`` true and nulls.

    Blank lines are left out; lines that are no objects or not JSON are bad.
    """
    schema = "case_id string, label string, " + ", ".join(f"{m} int" for m in MARKS) + ", blocker boolean, notes string"
    full = lines.where(F.col(column).rlike(r"\S"))
    parsed = F.from_json(F.col(column), f"struct<{schema}, _bad string>", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    read = full.select(parsed.alias("j"), F.trim(column).alias("_line"))
    bad = F.col("j").isNull() | F.col("j._bad").isNotNull() | ~F.startswith("_line", F.lit("{"))
    return read.select(bad.alias("bad"), *[F.when(~bad, F.col(f"j.{c.split()[0]}")).alias(c.split()[0]) for c in schema.split(", ")])


def judge_summary(marks: DataFrame, key: DataFrame) -> DataFrame:
    """By condition: lines, mean of each mark, mean weighted mark, blockers. ``key`` is (case_id, label, cond); lines without
    a key are counted under a null condition and not averaged."""
    joined = marks.where(~F.col("bad")).join(key, ["case_id", "label"], "left")
    weighted = sum((F.col(m) * w for m, w in MARKS.items()), F.lit(0.0))
    known = F.col("cond").isNotNull()
    means = [F.round(F.avg(F.when(known, F.col(m))), 6).alias(m) for m in MARKS]
    return joined.groupBy("cond").agg(F.count(F.lit(1)).alias("n"), *means, F.round(F.avg(F.when(known, weighted)), 6).alias("weighted"), F.count_if(F.coalesce("blocker", F.lit(False))).alias("blockers"))


def seeded_order(rows: DataFrame, keys: Sequence[str], item: str, seed: str) -> DataFrame:
    """Adds ``place``: a shuffled order of the items of each key that the seed alone decides (order of a hash). The keys'
    items are few (labels of a case)."""
    from pyspark.sql import Window

    h = F.sha2(F.concat_ws(":", F.lit(seed), *keys, item), 256)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(h, item)))


def specialists(scores: Column, mapping: dict[str, str], pad: Sequence[str], most: int) -> Column:
    """The specialists of the highest scored dimensions, each once, filled up from ``pad``; ``scores`` is an array of
    (dimension, score), ties by name."""
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    ordered = F.array_sort(F.transform(F.filter(scores, lambda s: s["score"] > 0), lambda s: F.struct((-s["score"]).alias("k"), s["dimension"].alias("d"))))
    picked = F.array_distinct(F.array_compact(F.transform(ordered, lambda s: F.try_element_at(known, s["d"]))))
    return F.slice(F.array_union(picked, F.array(*[F.lit(p) for p in pad])), 1, most)
