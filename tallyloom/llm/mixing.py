"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], linear between knots, whose integral is its target
share. The cumulative demand of a source is that integral up to t; a document copy that starts after c of the source's
T * share tokens stands at the time t at which the demand reaches c. The schedule is integrated on the knots and
inverted in closed form (a quadratic within a segment), inside the JVM, and copies are range-sorted by position.

Size: T is the largest total at which every source meets its share without exceeding its repeats,
T = min(max_repeats * size / share). Whole passes come first, the last pass is cut where the demand ends; the copy that
crosses the end is kept, so a source misses its share by less than one document.

Parallel: cumulative tokens inside a source come from salted running sums, so a source with a third of all rows is
summed in many tasks. Targets, sizes and schedules are one row for each source that has a target (checked bound).

Defined cases: spelling of sources is normalised; documents of a null source or of one without a target are not used
and reported with target 0; targets without documents are reported with share 0 and the others' shares are scaled up;
null or non-positive weights or repeats count as no target; texts of 0 tokens add nothing and are not used; repeated
documents are separate ones; no documents or no targets give no rows in the mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.scale import running_total, salt_of
from tallyloom.session import cut

#: Targets beyond this number are refused: they are joined as a broadcast.
MAX_SOURCES = 10_000
SALTS = 256
#: Greatest slope of the default schedule: from 1 - SLOPE to 1 + SLOPE times the source's share.
SLOPE = 0.5


def source_name(column: str) -> Column:
    name = F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-]+", "_")
    return F.when(name != "", name)


def default_schedules(sources: list[tuple[str, float, int]]) -> dict[str, list[float]]:
    """Relative weight at t = 0 and t = 1 for each source: the more a source is repeated, the later its weight grows.

    Tilts are centred by share, so at every t the weights of all sources add up to one.
    """
    total = sum(share for _, share, _ in sources)
    most = max((repeats for _, _, repeats in sources), default=1)
    raw = {name: (2 * repeats / most - 1) for name, _, repeats in sources}
    mean = sum(share * raw[name] for name, share, _ in sources) / total if total else 0.0
    scale = SLOPE / max(1.0, max((abs(x - mean) for x in raw.values()), default=1.0))
    return {name: [1 - scale * (x - mean), 1 + scale * (x - mean)] for name, x in raw.items()}


def integrated(weights: list[float]) -> list[tuple[float, float, float, float]]:
    """Segments (start, width, demand at the start, weight at the start, weight at the end) of a schedule scaled to integral 1."""
    if len(weights) < 2 or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("a schedule needs two or more non-negative weights, not all zero")
    width = 1 / (len(weights) - 1)
    area = sum((a + b) / 2 * width for a, b in zip(weights, weights[1:], strict=False))
    out, done = [], 0.0
    for i, (a, b) in enumerate(zip(weights, weights[1:], strict=False)):
        out.append((i * width, width, done, a / area, b / area))
        done += (a + b) / 2 * width / area
    return out


SEGMENTS = "array<struct<start:double,width:double,done:double,low:double,high:double>>"


def position(segments: Column, demand: Column) -> Column:
    """The time at which the integrated schedule reaches ``demand`` (a share of the source's tokens, 0 to 1)."""
    at = F.element_at(F.filter(segments, lambda s: s["done"] <= demand), -1)
    missing = F.greatest(demand - at["done"], F.lit(0.0))
    slope = (at["high"] - at["low"]) / at["width"]
    root = F.sqrt(F.greatest(at["low"] * at["low"] + 2 * slope * missing, F.lit(0.0)))
    # 2m / (a + sqrt(a^2 + 2 s m)): the stable form of the quadratic's root, also right for slope 0.
    step = F.when(missing > 0, 2 * missing / (at["low"] + root)).otherwise(0.0)
    return F.least(at["start"] + F.least(step, at["width"]), F.lit(1.0))


def sizes(documents: DataFrame, doc_id: str, source: str, size: str) -> DataFrame:
    return documents.select(F.col(doc_id).alias("doc_id"), source_name(source).alias("source"), F.col(size).cast("long").alias("tokens")).where("doc_id is not null")


def budget(docs: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry for each source with a target: share, size, repeats, tokens asked of it. At most MAX_SOURCES rows."""
    wanted = (
        targets.select(source_name("source").alias("source"), "weight", "max_repeats")
        .where("source is not null and weight > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    )
    held = docs.where("tokens > 0 and source is not null").groupBy("source").agg(F.sum("tokens").alias("size"))
    rows = wanted.join(held, "source", "left").select("source", "weight", "max_repeats", F.coalesce("size", F.lit(0)).alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources with a target")
    entries = sorted((r.asDict() for r in rows), key=lambda e: e["source"])
    live = sum(e["weight"] for e in entries if e["size"])
    for e in entries:
        e["share"] = e["weight"] / live if e["size"] else 0.0
    total = min((e["max_repeats"] * e["size"] / e["share"] for e in entries if e["share"]), default=0.0)
    for e in entries:
        e["asked"] = total * e["share"]
    return entries


def mixture(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", schedules: dict[str, list[float]] | None = None, seed: int = 17) -> DataFrame:
    """(position, source, doc_id, pass_no, tokens) in training order."""
    # Sizes are written once: the budget, the running sums and their offsets read them, not the texts.
    docs = cut(sizes(documents, doc_id, source, size).where("tokens > 0 and source is not null"))
    entries = [e for e in budget(docs, targets) if e["share"]]
    shapes = default_schedules([(e["source"], e["share"], e["max_repeats"]) for e in entries]) | (schedules or {})
    plan = docs.sparkSession.createDataFrame(
        [(e["source"], float(e["asked"]), int(e["size"]), int(e["max_repeats"]), integrated(shapes[e["source"]])) for e in entries],
        f"source string, asked double, size bigint, max_repeats int, segments {SEGMENTS}",
    )
    salted = docs.withColumn("_salt", salt_of(F.lit(seed), "doc_id", buckets=SALTS)).withColumn("_order", F.xxhash64(F.lit(seed + 1), "doc_id"))
    # The plan has at most MAX_SOURCES rows, checked in budget().
    placed = running_total(salted.join(F.broadcast(plan.select("source")), "source", "left_semi"), ["source"], "_salt", ["_order", "doc_id"], "tokens", "before")
    copies = placed.join(F.broadcast(plan), "source").withColumn(
        "pass_no", F.explode(F.sequence(F.lit(1), F.least(F.col("max_repeats"), F.ceil(F.col("asked") / F.col("size")).cast("int"))))
    )
    start = (F.col("pass_no") - 1) * F.col("size") + F.col("before")
    # A demand that ends exactly with a pass must not, by rounding, open another one.
    taken = copies.withColumn("_start", start).where(F.col("_start") < F.col("asked") - F.lit(1e-6) * F.col("size"))
    return taken.select(position(F.col("segments"), F.col("_start") / F.col("asked")).alias("position"), "source", "doc_id", "pass_no", "tokens").orderBy("position", "source", "doc_id", "pass_no")


def shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """For every source with documents or a target, the null source too: target and actual share, tokens, copies, passes."""
    docs = sizes(documents, doc_id, source, size)
    entries = budget(docs, targets)
    plan = docs.sparkSession.createDataFrame([(e["source"], e["share"], int(e["max_repeats"])) for e in entries], "source string, target_share double, max_repeats int")
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.max("pass_no").alias("passes"))
    # At most MAX_SOURCES rows, so one window over all of them stays small.
    used = used.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    held = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("held_tokens"))
    return (
        held.join(plan, "source", "full_outer")
        .join(used, "source", "left")
        .select(
            "source",
            F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
            F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("copies", F.lit(0)).alias("copies"),
            F.coalesce("passes", F.lit(0)).alias("passes"),
            "max_repeats",
            F.coalesce("documents", F.lit(0)).alias("documents"),
            F.coalesce("held_tokens", F.lit(0)).alias("held_tokens"),
        )
    )


def kept_targets(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """For every source with a target: the share asked for, the passes that takes, and whether the mixture keeps both (it
    misses the tokens asked for by less than the source's largest document and repeats nothing too often)."""
    docs = sizes(documents, "doc_id", "source", "size")
    entries = budget(docs.where("tokens > 0 and source is not null"), targets)
    plan = docs.sparkSession.createDataFrame([(e["source"], e["share"], float(e["asked"]), int(e["max_repeats"])) for e in entries], "source string, target_share double, asked double, max_repeats int")
    largest = docs.groupBy("source").agg(F.max("tokens").alias("largest"), F.sum("tokens").alias("held"))
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("pass_no").alias("passes"))
    met = (F.coalesce("tokens", F.lit(0)) >= F.col("asked") - 1) & (F.coalesce("tokens", F.lit(0)) <= F.col("asked") + F.coalesce("largest", F.lit(0)))
    return plan.join(largest, "source", "left").join(used, "source", "left").select("source", F.round("target_share", 9).alias("target_share"), F.round("asked", 3).alias("asked"), F.coalesce("held", F.lit(0)).alias("held_tokens"), met.alias("met"), (F.coalesce("passes", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"))
