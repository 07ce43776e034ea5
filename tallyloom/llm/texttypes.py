"""Per-document text types: statistic thresholds as noisy labelling functions under a latent class model.

Each labelling function is a threshold on one statistic of :mod:`tallyloom.llm.shape`. It speaks for one or more latent
types and is right or wrong at rates that nobody gives it: it fires in the types it speaks for with one probability and
in all others with another, and expectation-maximisation on the agreements of all functions over all texts learns both,
from a start at which every function counts alike (:data:`FIRES`). A function that fires at random ends with equal
rates and no say. Every text comes out with the posterior of each type; junk is the sum of its four latent kinds (noise,
dumps, heaps of words, damaged text). Texts with equal votes are one weighted pattern; with K functions there are at
most 2^K patterns, so the model is fitted on the driver from a table whose size does not depend on the number of texts.
The counts behind it cover all texts.

The posterior decides; beside it stands only what TESTDATA.md asks of a list or table, that entries or rows hold four
fifths of the visible characters, and that a text of less than 40 characters or of code is no case.

Defined cases: null and empty texts and texts without visible characters fire nothing and are ``other``; headings do
not count; repeated rows count as often as they stand there; an empty table gives no rows and the starting model; ties
between types go to the first of :data:`TYPES`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shape import shape

TYPES = ("prose", "list", "table", "junk")
#: Latent types, and which type of text each is.
LATENT = {"prose": "prose", "list": "list", "table": "table", "noise": "junk", "dump": "junk", "heap": "junk", "damaged": "junk"}
#: Visible share that entries or rows must hold for a list or table, and the least length of a text that is judged.
WHOLE, LEAST_CHARS = 0.8, 40
#: Rates at which every function fires, before any text was seen, in the types it speaks for and in the others.
FIRES = (0.7, 0.3)
#: The starting rates count like so many texts.
PRIOR = 10.0
#: Up to so many patterns are broadcast.
BROADCAST_PATTERNS = 100_000


def functions(s: dict) -> list[tuple[str, str, bool]]:
    """(name, latent types it speaks for, fires) for one text. The order is part of the vote's encoding."""
    spaceless = s["cjk"] > s["latin"]
    common = s["common_cjk_share"] / 0.06 if spaceless else s["common_share"] / 0.2
    return [
        ("entries", "list table", s["entry_share"] >= WHOLE),
        ("marks", "list", s["lines"] > 0 and s["marked"] >= 0.5 * s["lines"]),
        ("many_lines", "list table dump", s["lines"] >= 4),
        ("rows", "table", s["row_share"] >= WHOLE),
        ("some_rows", "table", s["row_share"] >= 0.5),
        ("ends", "prose damaged", s["ended_share"] >= 0.4),
        ("common", "prose damaged", common >= 0.75),
        ("very_common", "prose", common >= 1.25),
        ("sentences", "prose damaged", s["sentences"] >= 1),
        ("plain_signs", "prose heap", s["symbol_share"] < 0.12),
        ("many_words", "prose heap", s["words"] + s["cjk"] / 2 >= 12),
        ("word_length", "prose heap", 3 <= s["mean_word"] <= 9),
        ("one_line", "prose noise heap damaged", s["lines"] <= 2),
        ("fenced", "prose", s["code_share"] >= 0.3),
        ("symbols", "noise damaged", s["symbol_share"] >= 0.25),
        ("markup", "noise", s["tag_share"] >= 0.4),
        ("encoded", "noise", s["long_code_share"] >= 0.5),
        ("digits", "noise dump", s["digit_share"] >= 0.4),
        ("hex", "dump", s["hex_share"] >= 0.5),
        ("rare", "list table noise dump heap", common < 0.3),
        ("vowelless", "heap", s["vowelless_share"] >= 0.4),
        ("broken", "damaged", s["broken_share"] >= 0.03),
        ("very_broken", "damaged", s["broken_share"] >= 0.1),
    ]


NAMES = [(name, tuple(kinds.split())) for name, kinds, _ in functions(shape(""))]
#: (function, latent type): whether the function speaks for the type.
SPEAKS = np.array([[k in kinds for k in LATENT] for _, kinds in NAMES])


def vote(s: dict) -> int:
    return sum(1 << i for i, (_, _, fires) in enumerate(functions(s)) if fires) if s["seen"] else 0


def votes(text: str | None) -> int:
    return vote(shape(text or ""))


#: Rates in its own types and in others for each function, and the share of each latent type.
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def starting_model() -> Model:
    return np.full(len(NAMES), FIRES[0]), np.full(len(NAMES), FIRES[1]), np.full(len(LATENT), 1 / len(LATENT))


def bits_of(patterns: list[tuple[int, int]]) -> np.ndarray:
    return np.array([[(v >> i) & 1 for i in range(len(NAMES))] for v, _ in patterns], dtype=float).reshape(len(patterns), len(NAMES))


def fit(patterns: list[tuple[int, int]], rounds: int = 200) -> Model:
    """Expectation-maximisation over (votes, number of texts)."""
    own, other, shares = start = starting_model()
    bits, n = bits_of(patterns), np.array([c for _, c in patterns], dtype=float)
    for _ in range(rounds if patterns else 0):
        mass = latent(bits, (own, other, shares)) * n[:, None]
        inside, outside = mass @ SPEAKS.T, mass @ ~SPEAKS.T
        fresh_own = ((bits * inside).sum(0) + PRIOR * start[0]) / (inside.sum(0) + PRIOR)
        fresh_other = ((bits * outside).sum(0) + PRIOR * start[1]) / (outside.sum(0) + PRIOR)
        moved = max(np.abs(fresh_own - own).max(), np.abs(fresh_other - other).max())
        own, other = np.clip(fresh_own, 1e-4, 1 - 1e-4), np.clip(fresh_other, 1e-4, 1 - 1e-4)
        shares = (mass.sum(0) + PRIOR / len(LATENT)) / (n.sum() + PRIOR)
        if moved < 1e-5:
            break
    return own, other, shares


def latent(bits: np.ndarray, model: Model) -> np.ndarray:
    """Posterior of each latent type."""
    own, other, shares = model
    rates = np.where(SPEAKS, own[:, None], other[:, None])
    logs = np.log(shares) + bits @ np.log(rates) + (1 - bits) @ np.log(1 - rates)
    logs -= logs.max(1, keepdims=True)
    p = np.exp(logs)
    return p / p.sum(1, keepdims=True)


def posterior(bits: np.ndarray, model: Model) -> np.ndarray:
    """Posterior of each of :data:`TYPES`."""
    return latent(bits, model) @ np.array([[float(kind == t) for t in TYPES] for kind in LATENT.values()])


MEASURED = {"votes": "int", "entry_share": "double", "row_share": "double", "code_share": "double", "seen": "int", "chars": "int"}


def measured(text: str | None) -> tuple:
    """The values of :data:`MEASURED` for one text."""
    s = shape(text or "")
    return vote(s), s["entry_share"], s["row_share"], s["code_share"], s["seen"], s["chars"]


def measure(texts: DataFrame, key: str, text: str, carry: tuple[str, ...] = (), also: dict[str, tuple[str, Callable]] | None = None, reads: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, the columns of MEASURED, *also), one pass over whole texts, which themselves are not handed on.

    ``also`` names further columns with their type and a function of (text, *reads), found in the same pass.
    """
    also = also or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"key": batch["key"], **{c: batch[c] for c in carry}}
            found = [measured(value) for value in batch["text"]]
            out |= {name: [f[i] for f in found] for i, name in enumerate(MEASURED)}
            for name, (_, f) in also.items():
                out[name] = [f(*values) for values in zip(batch["text"], *(batch[r] for r in reads), strict=True)]
            yield pd.DataFrame(out)

    rows = texts.select(F.col(key).alias("key"), *carry, F.col(text).alias("text"), *(F.col(r) for r in reads if r not in carry))
    types = dict(rows.dtypes)
    fields = {c: types[c] for c in ("key", *carry)} | MEASURED | {name: t for name, (t, _) in also.items()}
    return rows.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in fields.items()))


def patterns_of(measured: DataFrame) -> list[tuple[int, int]]:
    """(votes, number of texts): at most 2^K rows, whatever the number of texts."""
    return sorted((r["votes"], r["count"]) for r in measured.groupBy("votes").count().collect())


def typed(measured: DataFrame, model: Model | None = None) -> DataFrame:
    """Adds ``kind`` and the posterior of each type (p_prose, ...), fitting the model unless one is given.

    Each vote pattern is scored once; the table of patterns (at most 2^K rows) is joined as a broadcast while it is small.
    """
    patterns = patterns_of(measured)
    found = posterior(bits_of(patterns), model or fit(patterns))
    rows = [(v, TYPES[int(p.argmax())] if v else "other", *map(float, p)) for (v, _), p in zip(patterns, found, strict=True)]
    schema = "votes int, kind string, " + ", ".join(f"p_{t} double" for t in TYPES)
    scores = measured.sparkSession.createDataFrame(rows, schema)
    return measured.join(F.broadcast(scores) if len(rows) <= BROADCAST_PATTERNS else scores.hint("merge"), "votes")


def is_no_prose() -> Column:
    """Whether a typed row is a list, a table or junk by its posterior, a list or table also holding what it must. False for a null
    text."""
    held = (
        ((F.col("kind") == "list") & (F.greatest("entry_share", "row_share") >= WHOLE))
        | ((F.col("kind") == "table") & (F.col("row_share") >= WHOLE))
        | (F.col("kind") == "junk")
    )
    return F.coalesce(held & (F.col("chars") >= LEAST_CHARS) & (F.col("code_share") < 0.5), F.lit(False))


def no_prose(typed_texts: DataFrame) -> DataFrame:
    return typed_texts.where(is_no_prose())
