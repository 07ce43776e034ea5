"""Join shapes: suffix lookup, intervals, baseline semi and anti joins, overlap pairs, inverted index, division, diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def suffix_lookup(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """(row columns, matched): the first path, by ``position``, equal to ``file`` or ending with ``/`` + file.

    Instead of comparing every pair, each path is unfolded to its own suffixes at slashes, so the lookup is an equi-join.
    """
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 10_000), "/"))
    unfolded = paths.select("path", "position", F.explode(suffixes).alias("file"))
    first = unfolded.groupBy("file").agg(F.min_by("path", "position").alias("matched"))
    return rows.join(first, "file", "left")


def in_intervals(rows: DataFrame, spans: DataFrame, key: str, point: str, width: int = 64) -> DataFrame:
    """Rows whose ``point`` lies in a span [low, high] of the same key: a semi join on key and bin.

    Spans are unfolded to the bins they touch, rows have one bin, so no key is compared all against all.
    """
    bins = spans.select(key, "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("_bin"))
    marked = rows.withColumn("_bin", F.floor(F.col(point) / width))
    cond = (marked[key] == bins[key]) & (marked["_bin"] == bins["_bin"]) & (marked[point] >= bins["low"]) & (marked[point] <= bins["high"])
    return marked.join(bins, cond, "left_semi").drop("_bin")


def compare(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change): ``closed`` (old only), ``appeared`` (new only), ``kept``. Null keys equal each other.

    One grouped pass over both sides instead of three joins; it combines on the map side.
    """
    both = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n")))
    change = F.when((F.max("o") == 1) & (F.max("n") == 1), "kept").when(F.max("o") == 1, "closed").otherwise("appeared")
    return both.groupBy(*keys).agg(change.alias("change"))


#: A member that at least 1/DENSE of all items have is counted by bits, WORD members at once; the members of dense words are
#: numbered in blocks of about BLOCK. Items of one word are compared in cells of at most about CELL by CELL.
DENSE, WORD, BLOCK, CELL = 8, 64, 4096, 2048


def overlap_pairs(sets: DataFrame, item: str, members: str, least: int) -> DataFrame:
    """(a, b, shared): items a < b that share at least ``least`` members; ``item`` is unique. See :func:`shared_members`."""
    own = sets.select(item, F.array_distinct(members).alias("_ms")).where(F.size("_ms") >= least)
    return shared_members(own.select(item, F.explode("_ms").alias("_m")), item, "_m", least)


def shared_members(rows: DataFrame, item: str, member: str, least: int) -> DataFrame:
    """(a, b, shared): items a < b that have at least ``least`` members in common, from rows of (item, member). Nulls are
    neither items nor members, repeated rows count once.

    Only small numbers are joined, never an item's members. A member few items have stands in a word of its own, which
    its items are joined on. For members that very many items have, that would make nearly all pairs once a member; WORD of
    them share a word, in which an item has a mask, and a pair is made once a word. A word's pairs are spread over
    cells, so a member of very many items fills no single task. No side is broadcast, whatever its estimate, since
    estimates of grouped rows are far too small; sums combine on the map side.
    """
    flat = rows.select(F.col(item).alias("i"), F.col(member).alias("m")).where("i is not null and m is not null").distinct()
    total = flat.agg(F.count_distinct("i").alias("items"), F.count(F.lit(1)).alias("all"))
    often = flat.groupBy("m").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one row
    # There are at most DENSE * all / items dense members.
    blocks = F.ceil(DENSE * F.col("all") / F.col("items") / BLOCK)
    often = often.withColumn("dense", F.col("n") * DENSE >= F.col("items"))
    often = often.withColumn("block", F.when(F.col("dense"), F.pmod(F.xxhash64("m"), blocks)).otherwise(F.xxhash64("m")))
    block = Window.partitionBy("dense", "block")
    at = F.row_number().over(block.orderBy("m")) - 1
    side = F.ceil(F.max(F.when(F.col("dense"), F.col("items")).otherwise(F.col("n"))).over(block) / CELL).cast("int")
    places = often.select("m", "dense", "block", at.alias("at"), side.alias("side"))
    word = ["dense", "block", "word", "side"]
    bit = F.expr(f"shiftleft(1L, at % {WORD})")
    cells = flat.join(places.hint("merge"), "m").groupBy("i", "dense", "block", F.floor(F.col("at") / WORD).alias("word"), "side").agg(F.bit_or(bit).alias("mask"))
    own, every = F.pmod(F.hash("i"), F.col("side")), F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    left = cells.select(*word, F.col("i").alias("a"), F.col("mask").alias("_a"), own.alias("x"), every.alias("y"))
    right = cells.select(*word, F.col("i").alias("b"), F.col("mask").alias("_b"), every.alias("x"), own.alias("y"))
    both = F.col("_a").bitwiseAND(F.col("_b"))
    pairs = left.join(right.hint("merge"), [*word, "x", "y"]).where((F.col("a") < F.col("b")) & (both != 0))
    return pairs.groupBy("a", "b").agg(F.sum(F.bit_count(both)).alias("shared")).where(F.col("shared") >= least)


def complete(rows: DataFrame, key: str, value: str, wanted: Sequence) -> DataFrame:
    """Keys that have every wanted value (relational division)."""
    return rows.where(F.col(value).isin(*wanted)).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(wanted)).select(key)


def first_binding(rows: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """(key, value): any of several key columns leads to the value; the first binding by position wins."""
    cells = rows.select(F.explode(F.array(*[F.col(k) for k in keys])).alias("key"), value, position).where("key is not null")
    return cells.groupBy("key").agg(F.min_by(value, F.struct(position, value)).alias(value))


def with_replacement(rows: DataFrame, keys: Sequence[str], member: str, position: str) -> DataFrame:
    """Adds ``replacement``: the first other live row with the same keys and a shared member, or null."""
    other = rows.where("live").select(*keys, F.col("id").alias("other"), F.col(position).alias("_p"), F.explode(member).alias("_m"))
    mine = rows.select("id", *keys, F.explode(member).alias("_m"))
    hits = mine.join(other, [*keys, "_m"]).where("id != other").groupBy("id").agg(F.min_by("other", F.struct("_p", "other")).alias("replacement"))
    return rows.join(hits, "id", "left")


def previous_match(rows: DataFrame, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds the previous row's id within a partition."""
    return rows.withColumn("previous", F.lag("id").over(Window.partitionBy(*partition).orderBy(*order)))
