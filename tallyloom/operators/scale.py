"""Building blocks that stay parallel when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salt_of(*columns: Column | str, buckets: int) -> Column:
    """A bucket number that depends on the row's own values alone, so a lost task makes the same one again."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: str,
    before: str,
    total: str | None = None,
) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all rows of the same keys that stand earlier in the order (bucket, *order).

    No task ever sorts a whole key: a window runs inside (keys, bucket), and the totals of the buckets, of which
    there is one row for each key and bucket, give every bucket its offset. The rows are partitioned once by
    (keys, bucket); the second join brings the offsets to that same partitioning. ``order`` must be unique inside a
    bucket for a repeatable result. ``total`` adds the sum over the whole key. Null values count as 0; an empty input
    gives an empty result.
    """
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    amount = F.coalesce(F.col(value), F.lit(0)).cast("long")
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_total"))
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = [F.sum("_total").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = totals.select(*keys, bucket, (F.sum("_total").over(across) - F.col("_total")).alias("_offset"), *whole)
    running = df.withColumn("_inside", F.sum(amount).over(inside) - amount)
    return (
        running.join(offsets, [*keys, bucket])
        .withColumn(before, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )


def tasks_for(rows: DataFrame, megabytes: int = 64) -> int:
    """Number of tasks for a stage of Python work over ``rows``: two for every core, and more once a task would read more
    than so many megabytes as stored."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // (megabytes << 20)))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, shuffled by ``key`` only if they come in too few partitions to keep the cores busy (few files or row groups)."""
    return rows if rows.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(tasks_for(rows), key)


#: A key with more than 1/HOT of all rows is hot, so at most HOT keys are; below LEAST_HOT rows no key is.
HOT, LEAST_HOT = 1000, 100_000


def join_hot(rows: DataFrame, one: DataFrame, keys: Sequence[str], n: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` to ``one``, which has one row for each key and in ``n`` the key's number of ``rows``; ``n`` is
    dropped.

    Keys that hold more than 1/HOT of ``total`` rows (counted if not given) would each fill one task of a shuffled
    join. There are at most HOT of them, so they are joined by broadcast where ``rows`` stand; the other keys are
    shuffled and none is large. The result is that of a plain join.
    """
    total = rows.count() if total is None else total
    if total <= LEAST_HOT:
        return rows.join(one.drop(n), list(keys))
    hot = one.where(F.col(n) * F.lit(HOT) > F.lit(total))
    cold = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    # The rows left over are hinted away from a broadcast of ``one``, whose size is not bounded.
    return cold.join(one.drop(n).hint("merge"), list(keys)).unionByName(rows.join(F.broadcast(hot.drop(n)), list(keys)))


def successor(df: DataFrame, key: str, order: str, out: str, block: int = 1024) -> DataFrame:
    """Adds ``out``: the next larger existing ``order`` (an integer) of the same key, or null.

    ``df`` holds each (key, order) once. Windows run over blocks of ``block`` consecutive numbers; only the last row
    of a block looks at the block minima, of which there are ``block`` times fewer.
    """
    cell = F.floor(F.col(order) / F.lit(block)).alias("_cell")
    rows = df.withColumn("_cell", cell)
    inside = Window.partitionBy(key, "_cell").orderBy(order)
    rows = rows.withColumn("_next", F.lead(order).over(inside))
    cells = rows.groupBy(key, "_cell").agg(F.min(order).alias("_low"))
    cells = cells.withColumn("_later", F.lead("_low").over(Window.partitionBy(key).orderBy("_cell"))).drop("_low")
    return rows.join(cells, [key, "_cell"]).withColumn(out, F.coalesce("_next", "_later")).drop("_cell", "_next", "_later")
