"""Queries of sentence boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.sentences import ends
from tallyloom.operators.scale import spread
from tallyloom.sources import table


def sentence_ends(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, end_char) with one row for each sentence unit; a null or blank text has none, repeated rows are cut each.

    One pass, without a shuffle if the files give enough partitions; Arrow carries a list of ends for each text, which the JVM takes apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"].to_numpy(), "ends": [ends(t) for t in batch["text"]]})

    rows = spread(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    return rows.mapInPandas(run, f"key {dict(texts.dtypes)[key]}, ends array<int>").select("key", F.explode("ends").alias("end_char"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_ends(table(spark, folder, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "end_char")


def p9_units(spark: SparkSession, folder: str) -> DataFrame:
    """Number of units and mean length of a unit for each document."""
    return p9_found(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.max("end_char").alias("last_end"))


def p9_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Where the last unit of each document ends: at its last visible character."""
    return p9_found(spark, folder).groupBy("doc_id").agg(F.max("end_char").cast("long").alias("last_end"))


P9_COVER = r"select doc_id, length(regexp_replace(text, '[\s\x{3000}\x{00A0}]+$', '')) as last_end from documents where regexp_matches(text, '[^\s\x{3000}\x{00A0}]')"
QUERIES = {"p9_found": p9_found, "p9_units": p9_units, "p9_cover": p9_cover}
SQL = {"p9_cover": P9_COVER}
