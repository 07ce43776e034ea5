"""Leader clustering of findings and the merge of a cluster.

Two findings are one issue if they stand in the same file, have the same non-empty symbol or lines at most ``NEAR``
apart, and have the same category or one family. Findings are taken best first; each joins the first cluster whose
leader it matches, else it leads a new one. This is not a transitive closure.

Clusters never cross (file, family), so these are the groups; inside a group the order decides, so it is folded in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.findings import lookup

NEAR = 3
#: Categories that count as one family.
FAMILY_OF = {
    "COMPLEXITY": "size", "LARGE_METHOD": "size", "LARGE_CLASS": "size",
    "OVER_ENGINEERING": "design", "WRONG_ABSTRACTION": "design", "BOILERPLATE": "design",
    "CONCURRENCY": "runtime", "RESOURCE_SAFETY": "runtime", "PERFORMANCE": "runtime", "DATABASE": "runtime",
}
#: Providers whose word is no independent evidence.
NO_EVIDENCE = ("reviewer", "symbol-index")


class Fold:
    """Leaders of one group while its rows come best first.

    Leaders are kept by line and by symbol, so a row looks at no more than 2 * NEAR + 2 places.
    """

    def __init__(self) -> None:
        self.by_line: dict[int, tuple[int, str]] = {}
        self.by_symbol: dict[str, tuple[int, str]] = {}
        self.seen = 0

    def leader(self, id_: str, line: int, symbol: str) -> str:
        found = [self.by_line[x] for x in range(line - NEAR, line + NEAR + 1) if x in self.by_line]
        if symbol and symbol in self.by_symbol:
            found.append(self.by_symbol[symbol])
        self.seen += 1
        if found:
            return min(found)[1]
        self.by_line[line] = (self.seen, id_)
        if symbol:
            self.by_symbol[symbol] = (self.seen, id_)
        return id_


def clustered(rows: DataFrame) -> DataFrame:
    """(id, leader_id): every finding with the leader of its cluster. Null lines count as line 0.

    Rows are partitioned by (file, family), sorted best first inside the partition by Spark (which spills) and folded as
    a stream of batches, so no group is ever held in memory; what is held are the leaders of the group in hand.
    """
    family = F.coalesce(lookup(FAMILY_OF, F.col("category")), F.col("category"), F.lit(""))
    keyed = rows.select(
        "id", F.coalesce("file", F.lit("")).alias("file"), family.alias("family"), F.coalesce("rank", F.lit(-1)).cast("int").alias("rank"), F.coalesce(F.nanvl("confidence", F.lit(-1.0)), F.lit(-1.0)).alias("confidence"),
        F.coalesce("start_line", F.lit(0)).cast("int").alias("line"), F.coalesce("symbol", F.lit("")).alias("symbol"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fold = None, Fold()
        for batch in batches:
            leaders = []
            for file, kind, id_, line, symbol in zip(batch["file"], batch["family"], batch["id"], batch["line"], batch["symbol"], strict=True):
                if (file, kind) != group:
                    group, fold = (file, kind), Fold()
                leaders.append(fold.leader(id_, int(line), symbol))
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "leader_id": leaders})

    ordered = keyed.repartition("file", "family").sortWithinPartitions("file", "family", F.desc("rank"), F.desc("confidence"), "id")
    return ordered.mapInPandas(run, "id string, leader_id string")


def merged(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row for each cluster: size, raised confidence, flags, sources."""
    joined = rows.join(clusters, "id")
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("sources", F.array().cast("array<string>"))))))
    usable = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    grouped = joined.groupBy("leader_id").agg(
        F.count(F.lit(1)).alias("members"), F.max(usable).alias("best"), F.bool_or("introduced").alias("introduced"), F.bool_and("historical").alias("historical"), F.max("rank").alias("rank"), sources.alias("sources")
    )
    independent = F.size(F.array_except("sources", F.array(*[F.lit(s) for s in NO_EVIDENCE])))
    raised = F.when(independent >= 2, F.least(F.col("best") + 0.05, F.lit(0.99))).otherwise(F.col("best"))
    return grouped.withColumn("confidence", F.round(raised, 6)).drop("best")
