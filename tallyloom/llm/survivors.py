"""Best representative of each duplicate group, value by value.

Groups. Rows that share an id are one group: connected components of the ids by alternating large-star and small-star
steps, each written to the shared checkpoint folder; a hub's minimum is a map-side combined aggregate, and its links are
joined to that minimum by :func:`tallyloom.operators.scale.join_hot`, so no neighbourhood is gathered in one task.
Nothing but counts reaches the driver.

Quality model. Values claimed for a (group, field) by the reports' sources are facts that are true or false, and several
facts of one field may be true (a two-sided latent truth model). A source that speaks about a field claims the values
it names and denies those it does not. Expectation-maximisation infers each source's sensitivity (share of true values
it names) and specificity (share of false values it does not name) and each fact's probability of being true. Facts
with the same pattern of claims and denials are one weighted row, so an iteration reads patterns, not reports; what
reaches the driver in an iteration is three numbers for each source, and sources are the listed providers and one
``(unlisted)``, a bound that does not grow with the reports.

Survivor. :func:`survivors` ranks the claims of a field by a policy. ``BY_TRUTH``: the value's probability under the
model, then trust, date and id. ``BY_TRUST`` is the order that TESTDATA.md fixes (trust rank of the best source, latest
report, smallest id); it is total, so the model has nothing to decide there and is not fitted. :func:`true_values` keeps
every value judged true, several of a field if so.

Defined cases: null ids, ids without a report and null ``merged_ids`` are ignored; a group whose ids are all unknown
gives no row; repeated deliveries of a report count once, the one received last; reports without a listed source come
last and are claims of ``(unlisted)``; unusable values (see :func:`usable`) are no claims; a field without claims gives
no row; NaN is unusable; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.scale import join_hot
from tallyloom.session import cut

#: Fixed values.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
PROOFS = ("SUSPECTED", "LIKELY", "PROVEN")
#: Texts that stand in for a missing title or symbol, lower case.
STAND_INS = ("", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "tbd", "todo", "undefined", "unknown", "unset", "missing", "<none>", "<null>", "(none)", "(null)", "<unknown>", "not set", "not available")
FIELDS = ("title", "severity", "confidence", "end_line", "symbol", "perf_confidence")
UNLISTED = "(unlisted)"
#: More listed providers than this are refused.
MAX_PROVIDERS = 10_000
ROUNDS = 40
BY_TRUST, BY_TRUTH = "trust", "truth"


def present_ids(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """(a, b): links of the ids of one row, from its smallest known id; single known ids link to themselves.

    The ids gathered again are those of one row, no more than the row held.
    """
    ids = F.array_distinct(F.filter(F.concat(F.array("kept_id"), F.coalesce("merged_ids", F.array().cast("array<string>"))), lambda i: i.isNotNull()))
    rows = groups.select(F.array_sort(ids).alias("ids")).where(F.size("ids") > 0).distinct()
    told = rows.select(F.xxhash64("ids").alias("row"), F.sha2(F.concat_ws("\u0001", "ids"), 256).alias("sha"), F.explode("ids").alias("id"))
    known = told.join(findings.select("id").where("id is not null").distinct(), "id", "left_semi")
    return known.groupBy("row", "sha").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("a"), F.explode("ids").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, group_key): every id with the smallest id it is connected to. ``links`` is (a, b), self links for lone ids."""
    links = cut(links)
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        links_left, open_ends = _shape(edges)
        if not open_ends:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = join_hot(both, low, ["u"], "n", 2 * links_left).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Every u of ``large`` has its smallest neighbour below it, so the small-star step needs no self row.
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, low, ["u"], "n", 2 * links_left).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = cut(small)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("group_key")), "id", "left").withColumn("group_key", F.coalesce("group_key", "id"))


def _shape(edges: DataFrame) -> tuple[int, int]:
    """Number of links and of ids that are still open: an upper end with several lower ends or that is a lower end too. Without
    such ids the links are stars and nothing is left to do."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("e"))
    by_id = ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
    row = by_id.agg(F.sum("up").alias("links"), F.count(F.when((F.col("up") > 1) | (F.col("up") > 0) & (F.col("n") > F.col("up")), 1)).alias("open")).first()
    return row["links"] or 0, row["open"]


def latest_reports(findings: DataFrame) -> DataFrame:
    fields = ["title", "severity", "confidence", "start_line", "end_line", "symbol", "perf_confidence", "sources", "reported_at"]
    kept = findings.where("id is not null").select("id", F.struct("received_at", F.struct(*fields).alias("body")).alias("r"))
    return kept.groupBy("id").agg(F.max("r").alias("r")).select("id", "r.body.*")


def provider(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"\s*:.*$", ""))), r"[\s_]+", "-")


def listed(providers: DataFrame) -> dict[str, int]:
    """Providers and their trust rank; a bounded dimension (checked)."""
    rows = providers.where("provider is not null and trust_rank is not null").groupBy(provider(F.col("provider")).alias("p")).agg(F.min("trust_rank").alias("r")).limit(MAX_PROVIDERS + 1).collect()
    if len(rows) > MAX_PROVIDERS:
        raise ValueError(f"more than {MAX_PROVIDERS} providers")
    return {r["p"]: r["r"] for r in rows}


def _usable_text(column: str) -> Column:
    trimmed = F.trim(F.regexp_replace(F.col(column), r"[\s 　​﻿]+", " "))
    return F.when(~F.lower(trimmed).isin(*STAND_INS), trimmed)


def usable() -> dict[str, Column]:
    """The usable value of each field of a report, as text, or null.

    Usable: a title or symbol that is no stand-in; severity LOW..CRITICAL and perf_confidence SUSPECTED..PROVEN in any
    letter case; 0 <= confidence <= 1; end_line >= start_line.
    """
    return {
        "title": _usable_text("title"),
        "severity": F.when(F.upper(F.trim("severity")).isin(*SEVERITIES), F.upper(F.trim("severity"))),
        "confidence": F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.format_string("%.4f", "confidence")),
        "end_line": F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line").cast("string")),
        "symbol": _usable_text("symbol"),
        "perf_confidence": F.when(F.upper(F.trim("perf_confidence")).isin(*PROOFS), F.upper(F.trim("perf_confidence"))),
    }


def spoken(ranks: dict[str, int]) -> tuple[Column, Column]:
    """(speakers, trust): the listed providers of a report, sorted, or ``(unlisted)``; the best rank of them, null without."""
    known = F.create_map(*[F.lit(x) for pair in sorted(ranks.items()) for x in pair]) if ranks else F.create_map().cast("map<string,int>")
    named = F.array_distinct(F.transform(F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s.isNotNull()), provider))
    valued = F.filter(named, lambda s: F.try_element_at(known, s).isNotNull())
    speakers = F.when(F.size(valued) > 0, F.array_sort(valued)).otherwise(F.array(F.lit(UNLISTED)))
    return speakers, F.array_min(F.transform(valued, lambda s: F.try_element_at(known, s)))


def claims(reports: DataFrame, ranks: dict[str, int], *carry: str) -> DataFrame:
    """(id, reported_at, *carry, trust, speakers, field_name, value): every usable value of every report."""
    speakers, trust = spoken(ranks)
    cells = F.array(*[F.struct(F.lit(name).alias("field_name"), value.alias("value")) for name, value in usable().items()])
    rows = reports.select("id", "reported_at", *carry, trust.alias("trust"), speakers.alias("speakers"), F.explode(F.filter(cells, lambda c: c["value"].isNotNull())).alias("c"))
    return rows.select("id", "reported_at", *carry, "trust", "speakers", "c.field_name", "c.value")


def facts(grouped: DataFrame) -> DataFrame:
    """(group_key, field_name, value, yes, no): the sources that claim and that deny each value.

    Sources are few (bounded by the providers), so the sets stay small however large the group.
    """
    spoken = grouped.select("group_key", "field_name", "value", F.explode("speakers").alias("s")).distinct()
    yes = spoken.groupBy("group_key", "field_name", "value").agg(F.array_sort(F.collect_set("s")).alias("yes"))
    heard = spoken.groupBy("group_key", "field_name").agg(F.array_sort(F.collect_set("s")).alias("heard"), F.count_distinct("value").alias("n"))
    return join_hot(yes, heard, ["group_key", "field_name"], "n").select("group_key", "field_name", "value", "yes", F.array_except("heard", "yes").alias("no"))


def quality(patterns: DataFrame, sources: list[str], rounds: int = ROUNDS) -> tuple[dict[str, tuple[float, float]], float]:
    """Sensitivity and specificity of each source and the share of true facts, by expectation-maximisation.

    ``patterns`` is (yes, no, n). Each round is one aggregate over the patterns; the driver holds numbers by source.
    Weak priors keep a source that never disagrees inside (0, 1).
    """
    rates = {s: (0.7, 0.8) for s in sources}
    share = 0.5
    # Each pattern's claims and denials, and under an empty name the pattern itself: one aggregate gives all sums.
    said = F.concat(
        F.array(F.struct(F.lit("").alias("s"), F.lit(-1).alias("y"))),
        F.transform("yes", lambda s: F.struct(s.alias("s"), F.lit(1).alias("y"))),
        F.transform("no", lambda s: F.struct(s.alias("s"), F.lit(0).alias("y"))),
    )
    for _ in range(rounds):
        told = (
            patterns.withColumn("p", posterior(rates, share))
            .select("n", "p", F.explode(said).alias("v"))
            .groupBy("v.s", "v.y")
            .agg(F.sum(F.col("n") * F.col("p")).alias("t"), F.sum("n").alias("n"))
            .collect()
        )
        seen = {(r["s"], r["y"]): (r["t"], r["n"] - r["t"]) for r in told}
        if ("", -1) not in seen:
            break
        true, false = seen["", -1]
        fresh = {}
        for s in sources:
            (ty, fy), (tn, fn) = seen.get((s, 1), (0.0, 0.0)), seen.get((s, 0), (0.0, 0.0))
            fresh[s] = ((ty + 7) / (ty + tn + 10), (fn + 8) / (fy + fn + 10))
        new_share = min(max((true + 5) / (true + false + 10), 0.05), 0.95)
        moved = max([abs(a - b) for s in sources for a, b in zip(fresh[s], rates[s], strict=True)] + [abs(new_share - share)])
        rates, share = fresh, new_share
        if moved < 1e-3:
            break
    return rates, share


def posterior(rates: dict[str, tuple[float, float]], share: float) -> Column:
    """Probability that a fact with the columns ``yes`` and ``no`` is true."""
    if not rates:
        return F.lit(share)
    claim = F.create_map(*[x for s, (a, b) in sorted(rates.items()) for x in (F.lit(s), F.lit(math.log(a) - math.log(max(1 - b, 1e-12))))])
    deny = F.create_map(*[x for s, (a, b) in sorted(rates.items()) for x in (F.lit(s), F.lit(math.log(max(1 - a, 1e-12)) - math.log(b)))])
    zero = F.lit(0.0)
    odds = F.aggregate("yes", zero, lambda t, s: t + F.coalesce(F.try_element_at(claim, s), zero)) + F.aggregate("no", zero, lambda t, s: t + F.coalesce(F.try_element_at(deny, s), zero))
    return 1 / (1 + F.exp(-(odds + F.lit(math.log(share / (1 - share))))))


def grouped_reports(findings: DataFrame, groups: DataFrame) -> DataFrame:
    """The reports that are in a group, with ``group_key``."""
    return latest_reports(findings).join(components(present_ids(groups, findings)), "id")


def judged(findings: DataFrame, groups: DataFrame, providers: DataFrame) -> tuple[DataFrame, DataFrame, dict, float]:
    """Claims with their group, facts with their probability, the sources' rates and the share of true facts."""
    ranks = listed(providers)
    grouped = cut(claims(grouped_reports(findings, groups), ranks, "group_key"))
    told = cut(facts(grouped))
    patterns = cut(told.groupBy("yes", "no").agg(F.count(F.lit(1)).alias("n")))
    rates, share = quality(patterns, [*sorted(ranks), UNLISTED])
    return grouped, told.withColumn("truth", posterior(rates, share)), rates, share


def _ranked(trust: Column) -> list[Column]:
    recent = -F.coalesce(F.unix_micros("reported_at"), F.lit(-(2**62)))
    return [F.coalesce(trust, F.lit(2**31 - 1)).alias("trust"), recent.alias("recent"), F.col("id").alias("id")]


def survivors(findings: DataFrame, groups: DataFrame, providers: DataFrame, policy: str = BY_TRUST) -> DataFrame:
    """(group_key, field_name, finding_id, value): for each field of a group the claim that wins; ``truth`` too where the
    model decides. The least struct combines on the map side, so a hot group sends one row a task."""
    if policy == BY_TRUST:
        # One pass over whole reports: all fields of a group are settled in the same aggregate.
        keys = _ranked(spoken(listed(providers))[1])
        least = [F.min(F.when(value.isNotNull(), F.struct(*keys, value.alias("value")))).alias(name) for name, value in usable().items()]
        best = grouped_reports(findings, groups).groupBy("group_key").agg(*least)
        cells = F.array(*[F.struct(F.lit(name).alias("field_name"), F.col(name).alias("b")) for name in FIELDS])
        rows = best.select("group_key", F.explode(F.filter(cells, lambda c: c["b"].isNotNull())).alias("c"))
        return rows.select("group_key", "c.field_name", F.col("c.b.id").alias("finding_id"), F.col("c.b.value").alias("value"))
    claimed, told, _, _ = judged(findings, groups, providers)
    facts_of = ["group_key", "field_name", "value"]
    said = claimed.groupBy(*facts_of).agg(F.count(F.lit(1)).alias("n"))
    rows = join_hot(claimed, told.join(said, facts_of).select(*facts_of, "truth", "n"), facts_of, "n")
    best = rows.groupBy("group_key", "field_name").agg(F.min(F.struct((-F.col("truth")).alias("doubt"), *_ranked(F.col("trust")), "value")).alias("b"))
    return best.select("group_key", "field_name", F.col("b.id").alias("finding_id"), F.col("b.value").alias("value"), (-F.col("b.doubt")).alias("truth"))


def true_values(findings: DataFrame, groups: DataFrame, providers: DataFrame, at_least: float = 0.5) -> DataFrame:
    """(group_key, field_name, value, truth): every value judged true, several of a field if so."""
    return judged(findings, groups, providers)[1].where(F.col("truth") >= at_least).select("group_key", "field_name", "value", "truth")


def source_quality(findings: DataFrame, groups: DataFrame, providers: DataFrame) -> DataFrame:
    """(provider, sensitivity, specificity)."""
    rates = judged(findings, groups, providers)[2]
    schema = T.StructType([T.StructField("provider", T.StringType()), T.StructField("sensitivity", T.DoubleType()), T.StructField("specificity", T.DoubleType())])
    return findings.sparkSession.createDataFrame([(s, a, b) for s, (a, b) in sorted(rates.items())], schema)
