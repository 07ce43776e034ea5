"""Filling fixed-capacity containers: the plan is made from the histogram of lengths, never from the documents.

1. Count items by length. A length above the capacity C is cut into full pieces of C and one remainder; only such items
   are ever split. The histogram has at most C + 1 lengths, so it is small whatever the number of documents.
2. Plan on the driver, best fit in descending order of length over counts: containers with equal free space form a
   class, and a whole run of equal items goes into the class with the least free space that holds one, as many to a
   container as fit. A run says: ranks a..b of length L go, k at a time, to containers c, c+1, ...
3. Every item takes the slot of its rank within its length. Ranks come from salted running counts, so a length that a
   third of the items share is ranked in many tasks.

The plan's runs, not items, reach the executors: one row for each (limit, length), at most the sum of the capacities,
which is checked; they are broadcast if they are few (``BROADCAST_RUNS``), else joined by shuffle.

Defined cases: null ids are dropped, a null or empty text has length 0 and stands in the first container; repeated ids
are separate items (ranked by their place among equals, which then is not repeatable); no documents give no rows;
limits that are null or below 1 are ignored, repeated limit ids count once (the largest capacity).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.scale import running_total, salt_of
from tallyloom.session import cut

PLAN = "limit_id int, length int, runs array<struct<first:bigint,last:bigint,each:bigint,container:bigint>>"
#: Salt buckets of a length, so that a length which a third of the items share is ranked in many tasks.
SALTS = 256
#: More limits than this are refused, the driver plans each one; and more tokens of capacity in all, for the histogram
#: has a row for each length up to each capacity and the plan a run or more for each of its rows.
MAX_LIMITS, MAX_CAPACITY = 1000, 5_000_000
#: A plan of at most so many runs is broadcast; a larger one, of which there are at most a few for each length, is shuffled.
BROADCAST_RUNS = 200_000


def best_fit(histogram: Iterable[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, last rank, items for each container, first container) and the number of containers.

    Ranks start at 0, containers at 1. Free space -> stack of (first container, number of containers).
    """
    free: dict[int, list[tuple[int, int]]] = {}
    spaces: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    used = 0

    def put(space: int, first: int, count: int) -> None:
        if count:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, count))

    def take(space: int) -> tuple[int, int]:
        block = free[space].pop()
        if not free[space]:
            del free[space]
            spaces.pop(bisect_left(spaces, space))
        return block

    for length, count in sorted(histogram, reverse=True):
        if count <= 0:
            continue
        if length == 0:
            runs.append((0, 0, count - 1, count, 1))
            used = max(used, 1)
            continue
        rank = 0
        while rank < count:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, boxes = take(space)
            else:
                space, first = capacity, used + 1
                boxes = -(-(count - rank) // (capacity // length))
                used += boxes
            each = space // length
            left = count - rank
            full = min(boxes, left // each)
            if full:
                runs.append((length, rank, rank + full * each - 1, each, first))
                rank += full * each
                put(space - each * length, first, full)
            rest = boxes - full
            if rest and rank < count and count - rank < each:
                some = count - rank
                runs.append((length, rank, count - 1, some, first + full))
                rank = count
                put(space - some * length, first + full, 1)
                full, rest = full + 1, rest - 1
            put(space, first + full, rest)
    return runs, used


def items(documents: DataFrame, limits: list[tuple[int, int]], doc_id: str, size: str) -> DataFrame:
    """(limit_id, capacity, doc_id, piece, length): each document for each limit, cut only above the capacity."""
    known = F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity")) for i, c in limits])
    every = documents.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).alias("size"), F.explode(known).alias("l"))
    last = F.greatest(F.ceil(F.col("size") / F.col("l.capacity")), F.lit(1)) - 1
    pieces = every.where("doc_id is not null").select("l.limit_id", "l.capacity", "doc_id", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    return pieces.select(
        "limit_id",
        "capacity",
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        F.least(F.col("capacity"), F.col("size") - F.col("piece") * F.col("capacity")).cast("int").alias("length"),
    )


def read_limits(limits: DataFrame) -> list[tuple[int, int]]:
    rows = limits.where("limit_id is not null and capacity_tokens >= 1").groupBy("limit_id").agg(F.max("capacity_tokens").alias("c")).limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    if sum(r["c"] for r in rows) > MAX_CAPACITY:
        raise ValueError(f"more than {MAX_CAPACITY} tokens of capacity in all")
    return sorted((r["limit_id"], r["c"]) for r in rows)


def plan(spark: SparkSession, pieces: DataFrame, limits: list[tuple[int, int]]) -> tuple[DataFrame, int]:
    """One row for each (limit, length) with its runs, and the number of runs; the histogram has at most sum(capacity + 1)
    rows, checked in :func:`read_limits`."""
    counts: dict[int, list[tuple[int, int]]] = {}
    for row in pieces.groupBy("limit_id", "length").count().collect():
        counts.setdefault(row["limit_id"], []).append((row["length"], row["count"]))
    rows = []
    for limit, capacity in limits:
        by_length: dict[int, list] = {}
        for length, first, last, each, box in best_fit(counts.get(limit, []), capacity)[0]:
            by_length.setdefault(length, []).append((first, last, each, box))
        rows += [(limit, length, runs) for length, runs in by_length.items()]
    return spark.createDataFrame(rows, PLAN), sum(len(runs) for _, _, runs in rows)


def pack(documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", size: str = "size") -> DataFrame:
    """(limit_id, capacity, doc_id, piece, length, container) with one row for each piece."""
    spark, known = documents.sparkSession, read_limits(limits)
    if not known:
        known = [(0, 1)]
        documents = documents.limit(0)
    # Sizes are written once: the histogram, the ranks and their offsets read them, not the texts.
    pieces = items(cut(documents.select(doc_id, size)), known, doc_id, size)
    slots, runs = plan(spark, pieces, known)
    ranked = running_total(
        pieces.withColumn("_salt", salt_of("doc_id", "piece", buckets=SALTS)).withColumn("_one", F.lit(1)),
        ["limit_id", "length"],
        "_salt",
        ["doc_id", "piece"],
        "_one",
        "rank",
    )
    run = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") <= r["last"])), 1)
    placed = ranked.join(F.broadcast(slots) if runs <= BROADCAST_RUNS else slots.hint("merge"), ["limit_id", "length"]).withColumn("run", run)
    container = F.col("run.container") + F.floor((F.col("rank") - F.col("run.first")) / F.col("run.each"))
    return placed.select("limit_id", "capacity", "doc_id", "piece", "length", container.cast("bigint").alias("container"))


def fill(packed: DataFrame) -> DataFrame:
    """For each limit: containers, tokens, share filled, and the least number of containers any packing needs."""
    boxes = packed.groupBy("limit_id", "capacity", "container").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return boxes.groupBy("limit_id", "capacity").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("n").alias("pieces"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        (F.sum("tokens") / (F.count(F.lit(1)) * F.first("capacity"))).alias("filled"),
        F.ceil(F.sum("tokens") / F.first("capacity")).alias("least_containers"),
    )


def checked(packed: DataFrame, documents: DataFrame, doc_id: str = "doc_id", size: str = "size") -> DataFrame:
    """For each limit what must hold of any right packing: every token placed once, no container over its capacity, no
    item cut that would have fitted whole, and no more containers than best fit descending may use (11/9 of the least + 1)."""
    boxes = fill(packed)
    per_item = packed.groupBy("limit_id", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"))
    wrong = per_item.groupBy("limit_id").agg(F.count_if((F.col("n") > 1) & (F.col("size") <= F.col("capacity"))).alias("needless_cuts"), F.count(F.lit(1)).alias("items"))
    within = F.col("containers") <= F.ceil(F.col("least_containers") * 11 / 9) + 1
    return boxes.join(wrong, "limit_id").select("limit_id", "capacity", "items", "pieces", "tokens", "least_containers", (F.col("fullest") <= F.col("capacity")).alias("none_overfull"), "needless_cuts", within.alias("within_bound"))
