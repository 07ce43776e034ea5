"""Repetition inside a single document, with risk-controlled cutoffs.

Measure. A text becomes units: words, or single signs in scripts without spaces, in lower case, without punctuation
and running numbers. A unit is repeated if it lies in a later occurrence of a phrase (five words, eight signs; an
occurrence may overlap the earlier one, so short bits in a row count), or in a later occurrence of a whole sentence or
paragraph of any length. The repeated share weighs units by their characters. :func:`repeated_share` is this rule.

Decision. :func:`quick_score` is a cheap statistic of one text: the larger of the share of its short unit windows that
are not distinct and the share of its sentences and paragraphs, by length, that came before. A document is repetitive if
its score reaches the cutoff of its stratum (the script it is mostly written in). Cutoffs are risk-controlled: a labelled
holdout, the documents with the smallest hashes of the key (at most ``HOLDOUT`` a stratum), is labelled by the rule
above; for each stratum and each cutoff of a grid the exact binomial (Clopper-Pearson) tail tests "more than a share
alpha of the good documents are rejected", and Holm's correction over all strata and cutoffs keeps the chance that any
certified cutoff breaks its bound below ``DELTA``. alpha is ``ALPHA``, or, where the holdout's good documents are too
few to certify that at all, the least share they can certify (:func:`least_alpha`), so the same procedure runs at every
size. Any certified cutoff may be taken; it is the one with the fewest errors on the holdout, in the middle of those that
tie. The rule labels the holdout and decides nothing else.

Defined cases: null and empty texts and texts without units have share and score 0 and are never repetitive; repeated
rows are separate documents, in the holdout one; ties in the holdout's hash are settled by the key; a stratum without
holdout has no documents; an empty table gives no rows. A text is read whole, in time linear in its length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scale import salt_of
from tallyloom.session import cut

#: Phrase lengths and the share from which a document counts as repetitive.
WORDS, SIGNS, LEAST_SHARE = 5, 8, 0.4
HOLDOUT, ALPHA, DELTA = 4000, 0.002, 0.05
GRID = tuple(round(0.1 + 0.02 * i, 2) for i in range(36))
#: Windows of the quick score, in words or signs.
QUICK_WORDS, QUICK_SIGNS = 3, 4

_SPACELESS = "぀-ヿ㐀-䶿一-鿿\uf900-\ufaff฀-๿຀-໿က-႟ក-៿"
_UNIT = re.compile(rf"[{_SPACELESS}]|[^\s{_SPACELESS}]+")
_DROP = re.compile(rf"[\W\d_]+", re.UNICODE)
_BREAK = re.compile(r"(?<=[.!?؟।…])[\"'”’»)\]]*\s+|(?<=[。！？])[”’」』）]*|[\r\n]+")
_SIGN = re.compile(f"[{_SPACELESS}]")
_NUMBER = re.compile(r"[\d_]+")
#: Where the quick score parts sentences: a terminator before a space, a wide terminator, a line break.
_ROUGH_BREAK = re.compile(r"[.!?…؟।]\s|[。！？\r\n]")
_EDGES = " \t\"'`“”‘’„«»‹›「」『』()（）[]【】{}<>《》.,;:!?…。，、；：！？·•*#|+=/\\-–—~"
_MARK = re.compile(r"^\s*(?:[-*+•◦#>]+\s+|\(?\d{1,3}[.)、]\s*|\(?[a-z][.)]\s+)")


def units(text: str) -> list[str]:
    out = []
    for token in _UNIT.findall(text.casefold()):
        kept = _DROP.sub("", token) if len(token) > 1 or not token.isalpha() else token
        if kept:
            out.append(kept)
    return out


def repeated_share(text: str | None) -> float:
    """Share of the text's content that repeats earlier content of the same text, by the rule above."""
    if not text:
        return 0.0
    flat: list[str] = []
    spans: list[tuple[int, int]] = []
    for piece in _BREAK.split(text):
        found = units(_MARK.sub("", piece, count=1))
        if found:
            spans.append((len(flat), len(flat) + len(found)))
            flat += found
    n = len(flat)
    if not n:
        return 0.0
    again = bytearray(n)
    known: set = set()
    for a, b in spans:
        key = tuple(flat[a:b])
        if key in known:
            again[a:b] = b"\x01" * (b - a)
        known.add(key)
    signs = [len(u) == 1 and bool(re.match(f"[{_SPACELESS}]", u)) for u in flat]
    width_at = SIGNS if sum(signs) * 2 > n else WORDS
    phrases: set = set()
    covered = 0
    for i in range(n - width_at + 1):
        key = tuple(flat[i : i + width_at])
        if key in phrases:
            start = max(i, covered)
            again[start : i + width_at] = b"\x01" * (i + width_at - start)
            covered = i + width_at
        else:
            phrases.add(key)
    total = sum(map(len, flat))
    return sum(len(u) for u, hit in zip(flat, again, strict=True) if hit) / total


def stratum(text: str | None) -> str:
    """The kind of script that most of a text is in."""
    return "signs" if text and not text.isascii() and 3 * len(_SIGN.findall(text)) > len(text) else "words"


def quick_score(text: str | None) -> float:
    """See above; 0 for texts of fewer units than a window."""
    if not text:
        return 0.0
    low = _NUMBER.sub("", text.casefold())
    pieces = [x for piece in _ROUGH_BREAK.split(low) if (x := piece.strip(_EDGES))]
    total = sum(map(len, pieces))
    if not total:
        return 0.0
    again = 1 - sum(map(len, set(pieces))) / total
    kept = [x for unit in _UNIT.findall(low) if (x := unit.strip(_EDGES))]
    width = QUICK_SIGNS if stratum(text) == "signs" else QUICK_WORDS
    windows = list(zip(*(kept[i:] for i in range(width)), strict=False))
    return max(again, 1 - len(set(windows)) / len(windows)) if windows else again


#: The columns that :func:`repetitive` reads, for one pass over the texts.
SCORED = {"stratum": ("string", stratum), "score": ("double", quick_score)}


def scored(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stratum, score), one pass over whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"]} | {name: [f(t) for t in batch["text"]] for name, (_, f) in SCORED.items()})

    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, " + ", ".join(f"{n} {t}" for n, (t, _) in SCORED.items()))


def measured(rows: DataFrame) -> DataFrame:
    """(key, share) by the rule, reading whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "share": [repeated_share(t) for t in batch["text"]]})

    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, share double")


def holdout(rows: DataFrame, most: int = HOLDOUT) -> DataFrame:
    """At most ``most`` keys of each stratum with their score: those with the smallest hash, taken in two steps so that no
    task sorts a whole stratum."""
    keys = rows.where("key is not null").groupBy("stratum", "key").agg(F.max("score").alias("score"))
    hashed = keys.withColumn("_h", F.xxhash64(F.lit(5), "key")).withColumn("_salt", salt_of(F.lit(6), "key", buckets=64))
    first = Window.partitionBy("stratum", "_salt").orderBy("_h", "key")
    second = Window.partitionBy("stratum").orderBy("_h", "key")
    few = hashed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    return few.withColumn("_n", F.row_number().over(second)).where(F.col("_n") <= most).drop("_h", "_salt", "_n")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial X: the exact p-value of "the rate exceeds p" after k of n."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def least_alpha(n: int, tests: int, delta: float = DELTA) -> float:
    """The least share of false rejections that ``n`` good documents, none of them rejected, can certify among so many tests."""
    return 1 - (delta / tests) ** (1 / n) if n else 1.0


def certified(tests: dict[tuple[str, float], float], delta: float = DELTA) -> dict[str, list[float]]:
    """Holm's step-down over all (stratum, cutoff) p-values; the certified cutoffs of each stratum."""
    out: dict[str, list[float]] = {}
    ordered = sorted(tests.items(), key=lambda x: (x[1], x[0]))
    for i, ((where, cutoff), p) in enumerate(ordered):
        if p > delta / (len(ordered) - i) * (1 + 1e-9):
            break
        out.setdefault(where, []).append(cutoff)
    return {where: sorted(found) for where, found in out.items()}


def cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, tuple[float, float]]:
    """(cutoff, alpha certified for it) of each stratum from (stratum, score, share). Only counts by stratum and cutoff
    reach the driver."""
    good = F.col("share") < LEAST_SHARE
    wrong = [F.sum((good & (F.col("score") >= c)).cast("int")).alias(f"k{i}") for i, c in enumerate(GRID)]
    missed = [F.sum((~good & (F.col("score") < c)).cast("int")).alias(f"m{i}") for i, c in enumerate(GRID)]
    counts = {r["stratum"]: r for r in labelled.groupBy("stratum").agg(F.sum(good.cast("int")).alias("n"), *wrong, *missed).collect()}
    tests = len(counts) * len(GRID)
    bounds = {where: max(alpha, least_alpha(r["n"], tests, delta)) for where, r in counts.items()}
    allowed = certified({(where, c): tail(r[f"k{i}"], r["n"], bounds[where]) if r["n"] else 0.0 for where, r in counts.items() for i, c in enumerate(GRID)}, delta)
    out = {}
    for where, found in allowed.items():
        errors = {c: counts[where][f"k{GRID.index(c)}"] + counts[where][f"m{GRID.index(c)}"] for c in found}
        best = [c for c in found if errors[c] == min(errors.values())]
        out[where] = (best[len(best) // 2], bounds[where])
    return out


def repetitive(rows: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, stratum, score, cutoff, alpha): the documents whose score reaches their stratum's cutoff.

    ``rows`` holds (key, stratum, score) of the documents to judge and is read twice; ``texts_of`` gives the (key, text)
    of the keys of the holdout, at most HOLDOUT a stratum, so that they may be broadcast.
    """
    known = rows.where("score is not null")
    sample = cut(holdout(known))
    found = cutoffs(measured(texts_of(sample.select("key")).dropDuplicates(["key"])).join(sample, "key"))
    # A stratum that certifies nothing rejects nothing.
    cutoff, alpha = F.lit(None).cast("double"), F.lit(None).cast("double")
    for where, (value, bound) in sorted(found.items()):
        cutoff = F.when(F.col("stratum") == where, F.lit(value)).otherwise(cutoff)
        alpha = F.when(F.col("stratum") == where, F.lit(bound)).otherwise(alpha)
    return known.select("key", "stratum", "score", cutoff.alias("cutoff"), alpha.alias("alpha")).where(F.col("score") >= F.col("cutoff"))


def shares(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, share) of every document."""
    return measured(texts.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", "share")
