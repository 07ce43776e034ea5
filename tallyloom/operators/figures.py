"""Measures of laid-out figures from their boxes, and the choice between variants of a figure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a figure may be.
MOST_WIDTH, LEAST_WIDTH, LEAST_RATIO, MOST_RATIO, LEAST_COVERAGE, WIDE_GAP = 1200, 240, 0.25, 4.0, 0.12, 2.5


def measured(boxes: DataFrame, key: str) -> DataFrame:
    """(key, nodes, w, h, ratio, coverage, islands) from boxes (key, x, y, w, h).

    ``coverage`` is the boxes' area over that of what bounds them; ``islands`` counts the gaps between neighbouring centres,
    rounded and each once, that are wider than WIDE_GAP times the upper median gap, for three centres or more. A window's
    key is one figure.
    """
    area = F.greatest(F.lit(1.0), (F.max(F.col("x") + F.col("w")) - F.min("x")) * (F.max(F.col("y") + F.col("h")) - F.min("y")))
    sizes = boxes.groupBy(key).agg(
        F.count(F.lit(1)).alias("nodes"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.round(F.sum(F.col("w") * F.col("h")) / area, 6).alias("coverage")
    )
    centres = boxes.select(key, F.floor(F.col("x") + F.col("w") / 2 + 0.5).alias("c")).distinct()
    gaps = centres.withColumn("gap", F.col("c") - F.lag("c").over(Window.partitionBy(key).orderBy("c"))).where("gap is not null")
    ranked = gaps.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("gap", "c")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    median = F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("gap"))).over(Window.partitionBy(key))
    wide = ranked.withColumn("m", median).groupBy(key).agg(F.count_if((F.col("gap") > WIDE_GAP * F.col("m")) & (F.col("n") >= 2)).alias("islands"))
    joined = sizes.join(wide, key, "left")
    return joined.select(key, "nodes", "w", "h", F.round(F.try_divide(F.col("w"), F.col("h")), 6).alias("ratio"), "coverage", F.coalesce("islands", F.lit(0)).alias("islands"))


def violations(figures: DataFrame) -> DataFrame:
    """``figures`` with ``codes``: what each breaks."""
    rules = (
        ("width", F.col("w") > MOST_WIDTH), ("narrow", F.col("w") < LEAST_WIDTH), ("ratio", (F.col("ratio") < LEAST_RATIO) | (F.col("ratio") > MOST_RATIO)),
        ("coverage", F.col("coverage") < LEAST_COVERAGE), ("islands", F.col("islands") > 0),
    )
    return figures.withColumn("codes", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules])))


def best_variant(variants: DataFrame, key: str, variant: str) -> DataFrame:
    """(key, variant, points): the variant of each figure with the most points: a thousand less for every violation, the
    width beyond MOST_WIDTH less, ten times the coverage more; of equal ones the first by name."""
    points = F.round(-1000.0 * F.size("codes") - F.greatest(F.col("w") - MOST_WIDTH, F.lit(0)) + 10 * F.col("coverage"), 4)
    return variants.withColumn("points", points).groupBy(key).agg(F.min(F.struct((-F.col("points")).alias("p"), F.col(variant).alias("v"))).alias("b")).select(key, F.col("b.v").alias(variant), (-F.col("b.p")).alias("points"))
