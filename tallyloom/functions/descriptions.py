"""What a description of a tool says: clauses, tags, keywords, triggers and exclusions, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import CJK, cjk_bigrams, squeeze

#: What opens the clause of things a tool is not for, and how many triggers and exclusions are kept.
NEGATIVE = "(?i)not for|不适用|不用于|禁止用于|禁用于"
MOST_TRIGGERS, MOST_EXCLUSIONS, LONGEST_EXCLUSION = 24, 12, 32
#: Words that tell no tools apart; a parameter everywhere.
STOP_WORDS = tuple("the and for not with from this that when then use used into onto over under any all each can may must will are was were has have had but also only just more most such via code file files text list item items name names type types line lines".split())
_COMMAND = r"(?<![A-Za-z0-9_/])/([a-z][a-z0-9\-]+)(?![A-Za-z0-9_/.\-])"


def positive_clause(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.coalesce(text, F.lit("")), NEGATIVE, 2), F.lit(1)), F.lit(""))


def negative_clause(text: Column) -> Column:
    """What stands behind the first negative marker, empty without one."""
    return F.coalesce(F.try_element_at(F.split(F.coalesce(text, F.lit("")), NEGATIVE, 2), F.lit(2)), F.lit(""))


def _words(text: Column, least: int, stop: Sequence[str]) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"[A-Za-z][A-Za-z0-9_\-]{{{least - 1},}}"), F.lit(0)), lambda w: F.lower(F.regexp_replace(w, r"[_\-]+$", "")))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def derived_tags(description: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Latin words of three letters or more of the positive clause, sorted."""
    return F.array_sort(F.array_distinct(_words(positive_clause(description), 3, stop)))


def keywords(description: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Latin words of four letters or more and pairs of CJK signs, sorted."""
    pairs = F.filter(cjk_bigrams(F.coalesce(description, F.lit(""))), lambda p: F.length(p) == 2)
    return F.array_sort(F.array_distinct(F.concat(_words(F.coalesce(description, F.lit("")), 4, stop), pairs)))


def commands(text: Column) -> Column:
    """Commands like ``/name`` that are no part of a path."""
    return F.transform(F.regexp_extract_all(text, F.lit(_COMMAND), F.lit(1)), lambda c: F.concat(F.lit("/"), c))


def derived_triggers(description: Column, body: Column, paths: Sequence[str] = ("src", "docs", "tests", "scripts")) -> Column:
    """Phrases of ``trig:`` lines, commands and CJK phrases of 2 to 12 signs of the positive clause, in this order, each once."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), lambda x: x.rlike(r"^\s*trig\s*[:：]"))
    heads = F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^\s*trig\s*[:：]", ""), r"\bprio\s*:")[0])
    said = F.filter(F.transform(F.flatten(F.transform(heads, lambda h: F.split(h, "[|,，;；]"))), lambda p: F.trim(p)), lambda p: p != "")
    clause = positive_clause(description)
    named = F.filter(commands(clause), lambda c: ~c.isin(*[f"/{p}" for p in paths]))
    phrases = F.filter(F.split(clause, r"[^\x{4E00}-\x{9FFF}A-Za-z0-9\-]+"), lambda s: F.length(s).between(2, 12) & s.rlike(r"[\x{4E00}-\x{9FFF}]{2,}"))
    return F.slice(F.array_distinct(F.concat(said, named, phrases)), 1, MOST_TRIGGERS)


def derived_exclusions(description: Column) -> Column:
    """Commands and phrases of the negative clause, each once."""
    clause = negative_clause(description)

    def cleaned(part: Column) -> Column:
        s = F.trim(F.regexp_replace(part, r"\s+", " "))
        s = F.regexp_replace(s, r"(?i)^(?:or|and|but|nor|但|以及)\s+", "")
        s = F.regexp_replace(s, r"^/[A-Za-z][A-Za-z0-9\-]*\s*", "")
        return F.regexp_replace(s, r"^[ .。·\-—:：]+|[ .。·\-—:：]+$", "")

    phrases = F.filter(F.transform(F.split(clause, r"[,，、;；\n]+"), cleaned), lambda s: F.length(s).between(1, LONGEST_EXCLUSION) & s.rlike(r"[A-Za-z\x{4E00}-\x{9FFF}]") & ~F.lower(s).isin("or", "and", "but", "nor", "alone", "only", "just", "etc", "但", "以及", "也", "等"))
    return F.slice(F.array_distinct(F.concat(commands(clause), phrases)), 1, MOST_EXCLUSIONS)


def hint_hit(text: Column, hint: Column) -> Column:
    """A CJK hint anywhere in the text, another one as a whole word. ``text`` is in lower case; hints hold letters, digits,
    points and spaces."""
    edge = F.concat(F.lit("(?:^|[^a-z0-9_])"), F.regexp_replace(hint, r"([.+])", r"\\$1"), F.lit("(?:$|[^a-z0-9_])"))
    return F.when(hint.rlike(CJK), F.contains(text, hint)).otherwise(F.regexp_like(text, edge))


def first_hint(text: Column, table: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first class of the table any of whose hints the text holds; identifiers are read as their words."""
    low = squeeze(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), "_+", " "))
    out = F.lit(None).cast("string")
    for name, hints in reversed(table):
        out = F.when(F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: hint_hit(low, h)), name).otherwise(out)
    return out


def excludes(task: Column, phrases: Column) -> Column:
    """Whether a task (squeezed) holds one of the phrases: as it stands, or, for several words without CJK signs, all of its
    words of four letters or more."""

    def hit(phrase: Column) -> Column:
        p = squeeze(phrase)
        words = F.regexp_extract_all(p, F.lit("[a-z0-9]{4,}"), F.lit(0))
        return (p != "") & (F.contains(task, p) | (~p.rlike(r"[\x{4E00}-\x{9FFF}]") & (F.size(words) >= 2) & F.forall(words, lambda w: F.contains(task, w))))

    return F.exists(F.coalesce(phrases, F.array().cast("array<string>")), hit)
