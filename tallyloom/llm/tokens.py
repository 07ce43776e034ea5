"""Number of tokens of a text: pieces of the basic stage of the public BERT tokenizer, counted inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ideograph blocks that the public tokenizer's basic stage sets apart.
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
#: ASCII symbols count as punctuation beside the Unicode class.
MARKS = r"\p{P}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
SPACE = r"\p{Zs}\t\n\r"
DROPPED = r"[\x{FFFD}\x00]|(?![\t\n\r])[\p{Cc}\p{Cf}\p{Co}\p{Cs}\p{Cn}]"
PIECE = rf"[{IDEOGRAPHS}{MARKS}]|[^{IDEOGRAPHS}{MARKS}{SPACE}]+"


def token_count(text: Column) -> Column:
    """0 for a null or empty text. Characters that the stage drops do not part words."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), DROPPED, "")
    return F.regexp_count(kept, F.lit(PIECE)).cast("int")


def size_in_tokens(text: str = "text", known: str = "n_tokens") -> Column:
    """The delivered count where there is a possible one, else counted from the whole text."""
    return F.when(F.col(known) >= 0, F.col(known)).otherwise(token_count(F.col(text))).cast("int")
