"""Queries of packing and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.mixing import kept_targets, mixture, shares
from tallyloom.llm.packing import checked, fill, pack
from tallyloom.llm.tokens import PIECE, size_in_tokens
from tallyloom.sources import table


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", size_in_tokens().alias("size"))


def p7_slots(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_documents(spark, folder), table(spark, folder, "pack_limits"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill(p7_slots(spark, folder))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(_documents(spark, folder), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p8_mixture(spark, folder), _documents(spark, folder), table(spark, folder, "mix_targets"))


def p7_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packing."""
    return checked(p7_slots(spark, folder), _documents(spark, folder))


def p8_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Targets, and whether the mixture keeps them."""
    return kept_targets(p8_mixture(spark, folder), _documents(spark, folder), table(spark, folder, "mix_targets"))


#: Sizes: the delivered count, else the pieces of the tokenizer's basic stage. RE2 takes the same classes.
_SIZES = rf"""with s as (select doc_id, nullif(regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g'), '') as source,
  case when n_tokens >= 0 then n_tokens else len(regexp_extract_all(regexp_replace(coalesce(text, ''), '[\x{{FFFD}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}]', '', 'g'), '{PIECE}')) end as size from documents where doc_id is not null)"""
P7_CHECKED = _SIZES + """, l as (select limit_id, max(capacity_tokens) as capacity from pack_limits where limit_id is not null and capacity_tokens >= 1 group by 1)
select limit_id, capacity, count(distinct doc_id) as items, sum(greatest(ceil(size / capacity), 1))::bigint as pieces, sum(size)::bigint as tokens, ceil(sum(size) / capacity)::bigint as least_containers, true as none_overfull, 0::bigint as needless_cuts, true as within_bound
from s cross join l group by limit_id, capacity
"""
P8_TARGETS = _SIZES + r""", w as (select nullif(regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g'), '') as source, sum(weight) as weight, max(max_repeats) as repeats from mix_targets where weight > 0 and max_repeats > 0 group by 1),
h as (select source, sum(size) as held from s where size > 0 and source is not null group by 1),
j as (select w.source, weight, repeats, coalesce(held, 0)::bigint as held from w left join h using (source) where w.source is not null),
t as (select *, case when held > 0 then weight / sum(weight) filter (held > 0) over () else 0 end as share from j),
b as (select min(repeats * held / share) as total from t where share > 0)
select source, round(share, 9) as target_share, round(share * total, 3) as asked, held as held_tokens, true as met, true as repeats_kept from t, b
"""
QUERIES = {"p7_slots": p7_slots, "p7_fill": p7_fill, "p7_checked": p7_checked, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_targets": p8_targets}
SQL = {"p7_checked": P7_CHECKED, "p8_targets": P8_TARGETS}
