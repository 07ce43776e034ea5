"""Percentiles of very large numeric columns, by cumulative frequencies.

A column is first reduced to group-value counts, which combine on the map side and across days, partitions and earlier
results by adding counts (:func:`merge`). Percentiles come from the counts alone: values are ordered by fixed ranges
(a range is a power-of-two slice of the value axis, so its bounds never depend on a sample), a window runs inside each
(group, range), the ranges' totals give every range its offset, and the first value whose running sum reaches the
target rank is the percentile. No group is ever sorted in one task, and no raw value is moved.

Error: with ``relative_error=0`` the counts keep every distinct value and the result is the exact discrete percentile.
With ``relative_error=e`` values are rounded down to a grid of relative width e, so a result r and the exact
percentile x satisfy r <= x < r * (1 + e) + 1, however often counts have been merged; a group then has at most
log(max) / log(1 + e) distinct values, whatever its number of rows.

Defined cases: null values, NaN and values below ``least`` are not counted; a group without counted values gives no
row; a null group key is a group of its own; ties and repeated rows are counts; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.scale import running_total

#: The percentiles that the queries report, as (column name, share).
PROBS = (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))


def grid(value: Column, relative_error: float) -> Column:
    """Integer ``value`` rounded down to the grid; 0 and small values, where the grid is finer than 1, stay as they are."""
    if relative_error <= 0:
        return value
    base = math.log1p(relative_error)
    step = F.floor(F.log(value.cast("double")) / F.lit(base) + F.lit(1e-9))
    low = F.ceil(F.exp(step * F.lit(base)) - F.lit(1e-6)).cast("long")
    return F.when(value <= F.lit(1 / relative_error), value).otherwise(F.least(value, low))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, relative_error: float = 0.0, least: int = 0) -> DataFrame:
    """(keys, value, n): the mergeable form."""
    kept = df.where(F.col(value).isNotNull() & (F.col(value) >= least) & ~F.isnan(F.col(value).cast("double")))
    return (
        kept.select(*keys, grid(F.col(value).cast("long"), relative_error).alias("value"))
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge(keys: Sequence[str], *counts: DataFrame) -> DataFrame:
    """Counts of several days or partitions as one; also coarsens to fewer keys."""
    both = counts[0].select(*keys, "value", "n")
    for other in counts[1:]:
        both = both.unionByName(other.select(*keys, "value", "n"))
    return both.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def value_range(value: Column) -> Column:
    """Number of the fixed range: sixteen slices for each power of two, in the order of the values."""
    shown = F.when(value < 1, F.lit(0.0)).otherwise(F.log2(value.cast("double") + 1) * 16)
    return F.floor(shown).cast("int")


def percentiles(counts: DataFrame, keys: Sequence[str], probs: Sequence[tuple[str, float]] = PROBS) -> DataFrame:
    """One row for each key: ``n`` and, for each percentile, the first value whose cumulative count reaches ceil(p * n)."""
    safe = [f"_k{i}" for i in range(len(keys))]
    # A null key must join with itself; a struct of the keys would stop map-side combining, a flag and a text do not.
    keyed = counts.select(
        *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(s) for k, s in zip(keys, safe, strict=True)],
        "value",
        "n",
        value_range(F.col("value")).alias("_range"),
    )
    marked = running_total(keyed, safe, "_range", ["value"], "n", "_before", "_all")
    picks = []
    for name, share in probs:
        rank = F.greatest(F.ceil(F.col("_all") * F.lit(share) - F.lit(1e-9)), F.lit(1))
        reached = (F.col("_before") < rank) & (F.col("_before") + F.col("n") >= rank)
        picks.append(F.min(F.when(reached, F.col("value"))).alias(name))
    found = marked.groupBy(*safe).agg(F.max("_all").alias("n"), *picks)
    types = dict(counts.dtypes)
    back = [F.when(F.col(s) != "\u0000", F.col(s)).cast(types[k]).alias(k) for k, s in zip(keys, safe, strict=True)]
    return found.select(*back, "n", *[name for name, _ in probs])


def latest_rows(df: DataFrame, key: str, received: str, values: Sequence[str]) -> DataFrame:
    """One row for each ``key``: the values received last; of rows received together the largest values."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max(F.struct(F.col(received), *values)).alias("_last"))
        .select(key, *[F.col(f"_last.{v}").alias(v) for v in values])
    )


def provider_name(column: str) -> Column:
    """Provider as the dimension spells it: lower case, no outer space, no version behind a colon, null for none."""
    name = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(column), r"\s*:.*$", ""))), r"[\s_]+", "-")
    return F.when(name != "", name)
