"""Text functions as Column expressions, all inside the JVM. Classes are explicit ASCII or Unicode ranges, never ``\\w``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"


def squeeze(text: Column) -> Column:
    """Lower case, white space runs as one space, none outside."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def split_identifier(name: Column) -> Column:
    """camelCase and snake_case as words."""
    return squeeze(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-./]+", " "))


def domain_nouns(name: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words of an identifier of three letters or more, without stop words, sorted."""
    words = F.filter(F.split(split_identifier(name), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*stop) if stop else F.length(w) >= 3)
    return F.array_sort(F.array_distinct(words))


def cjk_bigrams(text: Column) -> Column:
    """Pairs of neighbouring CJK signs; a lone sign stands for itself."""
    runs = F.regexp_extract_all(text, F.lit(f"{CJK}+"), F.lit(0))
    pairs = F.transform(
        runs,
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))),
    )
    return F.flatten(pairs)


def tokens(text: Column) -> Column:
    """ASCII words in lower case and CJK bigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.concat(words, cjk_bigrams(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[A-Za-z0-9_]+|{CJK}"))


def token_estimate(text: Column) -> Column:
    """A quarter token for an ASCII sign, two thirds for a CJK one."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return (F.ceil((F.length(text) - cjk) / 4) + F.ceil(cjk * 2 / 3)).cast("long")


def token_estimate_wide(text: Column) -> Column:
    """A quarter token for an ASCII sign, one for any other."""
    ascii_signs = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_signs / 4 + (F.length(text) - ascii_signs)).cast("long")


def strip_space(text: Column) -> Column:
    """Outer white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def full_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: x.rlike(r"\S"))


def fact_density(text: Column) -> Column:
    """Share of non-blank lines that hold a digit, a path, a code mark or a table bar."""
    found = full_lines(text)
    return F.when(F.size(found) > 0, F.size(F.filter(found, lambda x: x.rlike(r"[0-9`|]|[a-z]/[a-z]"))) / F.size(found)).otherwise(0.0)


#: Shapes of secrets, in the order they are masked.
SECRET_SHAPES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"),
    (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "<ip>"),
    (r"\bAKIA[0-9A-Z]{16}\b", "<key>"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "<token>"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "<jwt>"),
    (r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S+", "<secret>"),
)


def redact(text: Column) -> Column:
    for shape, mask in SECRET_SHAPES:
        text = F.regexp_replace(text, shape, mask)
    return text


def first_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """The first word of the list that the text holds, by the list's order; null for none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), w) for w in words])


def normalised_sql(sql: Column) -> Column:
    """Lower case, literals and parameters as ``?``, single spaces, no closing semicolon."""
    out = F.regexp_replace(F.lower(sql), r"'[^']*'|:[a-z_]+|\b[0-9]+\b", "?")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r";\s*$", ""))


def hash_lines(text: Column) -> Column:
    """SHA-256 of the text with ``\\n`` ends and without blanks at line ends."""
    return F.sha2(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+\n", "\n"), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is not positive."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def normalised_condition(code: Column) -> Column:
    """A condition with its texts as ``STR`` and its numbers as ``NUM``, single spaces."""
    out = F.regexp_replace(F.trim(F.regexp_replace(code, r"\s+", " ")), r'"(?:\\.|[^"\\])*"', "STR")
    out = F.regexp_replace(out, r"'(?:\\.|[^'\\])*'", "STR")
    return F.trim(F.regexp_replace(out, r"\b[0-9]+(?:\.[0-9]+)?[fFdDlL]?\b", "NUM"))


def shared_sentence(a: Column, b: Column, least: int = 20) -> Column:
    """Whether any sentence of ``a`` of at least ``least`` characters stands in ``b``, as it is or with spaces squeezed."""
    parts = F.filter(F.transform(F.split(a, r"[.!?。！？\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return F.coalesce(F.exists(parts, lambda s: F.contains(b, s) | F.contains(squeeze(b), squeeze(s))), F.lit(False))


def front_matter(text: Column) -> Column:
    """(head, body): what stands between two ``---`` lines at the start, null without them, and the rest."""
    pattern = r"(?s)^---[ \t]*\r?\n(.*?\r?\n)?---[ \t]*(?:\r?\n|$)"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 1)).alias("head"), F.when(has, F.regexp_replace(text, pattern, "")).otherwise(text).alias("body"))


def front_fields(head: Column) -> Column:
    """The ``key: value`` lines of a front matter as a map; the last line of a key counts, lists and nested lines do not."""
    kept = F.filter(lines(F.coalesce(head, F.lit(""))), lambda x: x.rlike(r"^[A-Za-z_][A-Za-z0-9_\-]*:"))
    # Of repeated keys the last: pairs are taken from the end and each key once.
    pairs = F.reverse(F.transform(kept, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_][A-Za-z0-9_\-]*):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']|[\"']$", "").alias("v"))))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)))


def windowed(all_lines: Column, ranges: Column, radius: int) -> Column:
    """The lines of some ranges (structs low and high, 1-based, in order, not touching after they are widened by ``radius``)
    with a mark for what is left out before, between and behind them."""
    total = F.size(all_lines)
    wide = F.transform(ranges, lambda r: F.struct(F.greatest(r["low"] - radius, F.lit(1)).alias("a"), F.least(r["high"] + radius, total).alias("b")))
    gap = lambda n: F.when(n > 0, F.array(F.concat(F.lit("... ["), n.cast("string"), F.lit(" lines elided] ...")))).otherwise(F.array().cast("array<string>"))
    parts = F.transform(wide, lambda r, i: F.concat(gap(r["a"] - F.when(i > 0, F.try_element_at(wide, i)["b"]).otherwise(0) - 1), F.slice(all_lines, r["a"], F.greatest(r["b"] - r["a"] + 1, F.lit(0)))))
    return F.concat(F.flatten(parts), gap(total - F.try_element_at(wide, F.lit(-1))["b"]))


def cut_to_bytes(all_lines: Column, most: int) -> Column:
    """The first lines that fit into ``most`` bytes of UTF-8, line ends counted, with a mark if lines were cut."""
    sizes = F.transform(all_lines, lambda x: F.octet_length(x) + 1)
    state = F.aggregate(
        F.zip_with(all_lines, sizes, lambda x, n: F.struct(x.alias("x"), n.alias("n"))),
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full")),
        lambda s, e: F.when(s["full"] | (s["used"] + e["n"] > most), F.struct(s["kept"].alias("kept"), s["used"].alias("used"), F.lit(True).alias("full"))).otherwise(
            F.struct(F.concat(s["kept"], F.array(e["x"])).alias("kept"), (s["used"] + e["n"]).alias("used"), F.lit(False).alias("full"))
        ),
    )
    return F.when(state["full"], F.concat(state["kept"], F.array(F.lit(f"... [truncated at {most} bytes] ...")))).otherwise(all_lines)
