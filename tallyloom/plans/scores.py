"""Queries of ledgers, evaluations, scores, rankings, islands and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import scores as ops
from tallyloom.plans.base import Book
from tallyloom.sources import table

book = Book()

R = """with r as (select * from (select *, row_number() over (partition by run_id order by received_at desc) as rn from run_ledgers) where rn = 1)
"""


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "run_ledgers").where("run_id is not null")
    cols = [c for c in rows.columns if c not in ("run_id", "received_at")]
    return rows.groupBy("run_id").agg(F.max_by(F.struct(*cols), "received_at").alias("r")).select("run_id", "r.*")


@book.query(R + """select count(*) as runs, round(avg(input_tokens), 3) as avg_input, round(avg(output_tokens), 3) as avg_output, round(avg(cache_hit), 6) as cache_hit, round(avg(dedup_ratio), 6) as dedup_ratio,
  sum(findings)::bigint as debt, round(quantile_cont(case when duration_ms >= 0 then duration_ms::double end, 0.5), 4) as p50, round(quantile_cont(case when duration_ms >= 0 then duration_ms::double end, 0.95), 4) as p95 from r""")
def a8_ledger_summary(spark: SparkSession, folder: str) -> DataFrame:
    return ops.ledger_summary(_runs(spark, folder))


@book.query(R + """select mode, count(*) as runs, round(avg(input_tokens), 3) as avg_input, round(avg(output_tokens), 3) as avg_output, round(avg(cache_hit), 6) as cache_hit, round(avg(dedup_ratio), 6) as dedup_ratio,
  sum(findings)::bigint as debt, round(quantile_cont(case when duration_ms >= 0 then duration_ms::double end, 0.5), 4) as p50, round(quantile_cont(case when duration_ms >= 0 then duration_ms::double end, 0.95), 4) as p95 from r group by 1""")
def a9_percentiles_by_mode(spark: SparkSession, folder: str) -> DataFrame:
    return ops.ledger_summary(_runs(spark, folder), ["mode"])


@book.query(R + """select coalesce(upper(trim(gate)), '(none)') as gate, count(*) as n from r group by 1""")
def a8_gate_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).groupBy(F.coalesce(F.upper(F.trim("gate")), F.lit("(none)")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@book.query(R + """, t as (select unnest(tool_duration) as t from r) select lower(trim(t.provider)) as provider, count(*) as runs, round(avg(t.duration_ms), 4) as average, max(t.duration_ms) as longest, count(distinct t.status) as statuses
from t where t.duration_ms >= 0 group by 1""")
def a8_provider_durations(spark: SparkSession, folder: str) -> DataFrame:
    flat = _runs(spark, folder).select(F.explode("tool_duration").alias("t")).where("t.duration_ms >= 0")
    return flat.groupBy(F.lower(F.trim("t.provider")).alias("provider")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("t.duration_ms"), 4).alias("average"), F.max("t.duration_ms").alias("longest"), F.count_distinct("t.status").alias("statuses")
    )


@book.query(R + """, g as (select repo, count(*) filter (upper(gate) = 'PASS') / count(*) as success, avg(cache_hit) as accuracy, avg(input_tokens) as tokens, avg(duration_ms) filter (duration_ms >= 0) as time, 1 - avg(dedup_ratio) as stability from r group by 1),
p as (select repo, round(100 * greatest(0.0, least(1.0, success)), 4) as s, round(100 * greatest(0.0, least(1.0, coalesce(accuracy, 0.0))), 4) as a, round(100 * greatest(0.0, least(1.0, 3000.0 / (tokens + 1))), 4) as k,
  round(100 * greatest(0.0, least(1.0, 20000.0 / (coalesce(time, 0.0) + 1))), 4) as t, round(100 * greatest(0.0, least(1.0, coalesce(stability, 0.0))), 4) as b from g),
q as (select repo, round(0.35::double * s + 0.25::double * a + 0.15::double * k + 0.15::double * t + 0.10::double * b, 4) as score from p)
select repo, score, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' else 'D' end as grade from q""")
def a13_weighted_score(spark: SparkSession, folder: str) -> DataFrame:
    per = _runs(spark, folder).groupBy("repo").agg(
        (F.count_if(F.upper("gate") == "PASS") / F.count(F.lit(1))).alias("success"),
        F.coalesce(F.avg("cache_hit"), F.lit(0.0)).alias("accuracy"),
        F.avg("input_tokens").alias("tokens"),
        F.coalesce(F.avg(F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))), F.lit(0.0)).alias("time"),
        F.coalesce(1 - F.avg("dedup_ratio"), F.lit(0.0)).alias("stability"),
    )
    parts = {"success": F.col("success"), "accuracy": F.col("accuracy"), "tokens": 3000.0 / (F.col("tokens") + 1), "time": 20000.0 / (F.col("time") + 1), "stability": F.col("stability")}
    scored = per.select("repo", ops.weighted_score(parts).alias("score"))
    return scored.withColumn("grade", ops.grade(F.col("score")))


@book.query(R + """select repo, count(*) as n, first(findings order by started_at desc, run_id desc) as latest, round(avg(findings), 4) as average, max(findings) as best, min(findings) as worst from r group by 1""")
def a14_score_report(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("findings", F.struct("started_at", "run_id")).alias("latest"), F.round(F.avg("findings"), 4).alias("average"), F.max("findings").alias("best"), F.min("findings").alias("worst")
    )


A = """with a as (select * from (select *, row_number() over (partition by run_key order by received_at desc) as rn from runs_r10) where rn = 1),
e as (select lower(trim(id)) as id, max(mode) as mode, max(sticky) as sticky, max(prompt) as prompt from evals group by 1)
"""


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "runs_r10")
    return rows.groupBy("run_key").agg(F.max_by(F.struct("id", "cond", "output", "probe_expect"), "received_at").alias("r")).select("run_key", F.lower(F.trim("r.id")).alias("id"), "r.cond", "r.output", "r.probe_expect")


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "evals").groupBy(F.lower(F.trim("id")).alias("id")).agg(F.max("mode").alias("mode"), F.max("sticky").alias("sticky"), F.max("prompt").alias("prompt"))


@book.query(A + """select count(*) filter (e.id is null) as unmatched, count(*) filter (e.id is not null) as matched, count(distinct a.id) as ids from a left join e on lower(trim(a.id)) = e.id""")
def j7_key_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "runs_r10").groupBy("run_key").agg(F.max_by("id", "received_at").alias("raw")).withColumn("id", F.lower(F.trim("raw")))
    joined = rows.join(_cases(spark, folder).select("id", F.lit(True).alias("known")), "id", "left")
    return joined.agg(F.count_if(F.col("known").isNull()).alias("unmatched"), F.count_if("known").alias("matched"), F.count_distinct("raw").alias("ids"))


@book.query(A + """select lower(trim(id)) as id from a where cond in ('C0', 'C1', 'C2') group by 1 having count(distinct cond) = 3""")
def j18_complete_cases(spark: SparkSession, folder: str) -> DataFrame:
    from tallyloom.operators.joins import complete

    return complete(_answers(spark, folder), "id", "cond", ["C0", "C1", "C2"])


@book.query("""with b as (select * from (select *, row_number() over (partition by run_key order by received_at desc) as rn from blind_r2_c1) where rn = 1),
d as (select source, round_no, count(*) as n, round(avg(length(coalesce(output, ''))), 4) as mean_length from b group by 1, 2)
select source, round_no, n, mean_length, round(avg(mean_length) over (partition by source order by round_no rows between 2 preceding and current row), 3) as last_three from d""")
def a19_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Round over round with the mean of the last three; a window's key is one source after reduction to rounds."""
    rows = table(spark, folder, "blind_r2_c1").groupBy("run_key").agg(F.max_by(F.struct("source", "round_no", "output"), "received_at").alias("r")).select("r.*")
    per = rows.groupBy("source", "round_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length(F.coalesce("output", F.lit("")))), 4).alias("mean_length"))
    w = Window.partitionBy("source").orderBy("round_no").rowsBetween(-2, Window.currentRow)
    return per.withColumn("last_three", F.round(F.avg("mean_length").over(w), 3))


@book.query(A + """, c as (select distinct id from e), k as (select 'C' || unnest([0, 1, 2]) as cond) select cond, count(*) filter (n = 0) as missing, count(*) filter (n > 0) as present from (
  select c.id, k.cond, count(a.run_key) as n from c cross join k left join a on lower(trim(a.id)) = c.id and a.cond = k.cond group by 1, 2) group by 1""")
def z16_blind_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Cases without an answer under a condition: each case is unfolded to its three conditions."""
    cells = _cases(spark, folder).select("id", F.explode(F.array(*[F.lit(c) for c in ("C0", "C1", "C2")])).alias("cond"))
    have = _answers(spark, folder).select("id", "cond").distinct().withColumn("have", F.lit(1))
    return cells.join(have, ["id", "cond"], "left").groupBy("cond").agg(F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("have") == 1).alias("present"))


@book.query("""with s as (select repo, provider, count(*)::double as score from tool_timings where provider is not null group by 1, 2), b as (select *, max(score) over (partition by repo) as best from s),
k as (select *, row_number() over (partition by repo order by score desc, provider) as place from b where score >= 3 and score >= 0.45 * best)
select repo, provider, score, place from k where place <= 3""")
def o3_banded_top(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "tool_timings").where("provider is not null").groupBy("repo", "provider").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return ops.banded_top(counts, ["repo"], "score", "provider", 3, 3.0).select("repo", "provider", "score", F.col("place").cast("long").alias("place"))


@book.query("""with c as (select status as phase, provider, count(*) as score from tool_timings where provider is not null group by 1, 2),
b as (select phase, provider from (select *, row_number() over (partition by phase order by score desc, provider) as n from c) where n = 1)
select min(phase) as phase, provider from b group by provider""")
def o4_phase_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Best provider of each phase, each used once at its earliest phase."""
    counts = table(spark, folder, "tool_timings").where("provider is not null").groupBy(F.col("status").alias("phase"), "provider").agg(F.count(F.lit(1)).alias("score"))
    best = counts.groupBy("phase").agg(F.min_by("provider", F.struct(-F.col("score"), "provider")).alias("provider"))
    return best.groupBy("provider").agg(F.min("phase").alias("phase"))


S = """with s as (select distinct file, greatest(start_line - 80, 1) as low, start_line + 80 as high from findings where start_line is not null),
o as (select *, case when low <= max(high) over (partition by file order by low, high rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as fresh from s),
i as (select *, sum(fresh) over (partition by file order by low, high rows unbounded preceding) as island from o)
"""


@book.query(S + "select file, min(low)::bigint as low, max(high)::bigint as high, count(*) as spans from i group by file, island")
def w6_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Line ranges of +-80 merged into islands."""
    rows = table(spark, folder, "findings").where("start_line is not null")
    spans = rows.select("file", F.greatest(F.col("start_line") - 80, F.lit(1)).cast("long").alias("low"), (F.col("start_line") + 80).cast("long").alias("high")).distinct()
    return ops.islands(spans, "file", "low", "high")


@book.query("""with s as (select distinct file, start_line::bigint as low, greatest(coalesce(end_line, start_line) - start_line, 0)::bigint as size from findings where start_line is not null and file is not null),
o as (select *, case when low <= lag(low + size) over (partition by file order by low, size) then 0 else 1 end as fresh from s),
i as (select *, sum(fresh) over (partition by file order by low, size rows unbounded preceding) as island from o) select file, min(low) as low, max(low + size) as high, count(*) as spans from i group by file, island""")
def w7_chained_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Duplicate spans of a file merged with the span just before them."""
    rows = table(spark, folder, "findings").where("start_line is not null and file is not null")
    size = F.greatest(F.coalesce("end_line", "start_line") - F.col("start_line"), F.lit(0)).cast("long")
    return ops.chained_spans(rows.select("file", F.col("start_line").cast("long").alias("low"), size.alias("size")).distinct(), "file", "low", "size")


@book.query(R + "select repo, mode, first(run_id order by started_at desc, run_id desc) as run_id from r group by 1, 2")
def w13_latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return ops.latest_of(_runs(spark, folder), ["repo", "mode"], "run_id", ["started_at", "run_id"])


@book.query("select max(cast(regexp_extract(id, '([0-9]+)$', 1) as bigint)) + 1 as next_id from findings")
def w14_next_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "findings").agg((F.max(F.regexp_extract("id", "([0-9]+)$", 1).cast("long")) + 1).alias("next_id"))


@book.query("""select run_key, 'r10' as origin, length(output) as size, null::int as round_no from runs_r10 union all select run_key, 'blind', length(output), round_no from blind_r2_c1""")
def u1_union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "runs_r10").select("run_key", F.lit("r10").alias("origin"), F.length("output").cast("long").alias("size"))
    b = table(spark, folder, "blind_r2_c1").select("run_key", F.lit("blind").alias("origin"), F.length("output").cast("long").alias("size"), "round_no")
    return a.unionByName(b, allowMissingColumns=True)


@book.query("""select lower(trim(id)) as id from runs_r10 except select lower(trim(id)) from evals""")
def u4_difference(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "runs_r10").select(F.lower(F.trim("id")).alias("id"))
    return a.subtract(table(spark, folder, "evals").select(F.lower(F.trim("id")).alias("id")))


@book.query("""with u as (select id, cond, 1 as priority from runs_r10 union all select id, cond, 2 from blind_r2_c1) select id, cond, min(priority) as priority from u group by 1, 2""")
def u6_priority_union(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "runs_r10").select("id", "cond", F.lit(1).alias("priority")).unionByName(table(spark, folder, "blind_r2_c1").select("id", "cond", F.lit(2).alias("priority")))
    return u.groupBy("id", "cond").agg(F.min("priority").alias("priority"))


@book.query("""with m as (select kept_id as name, sha256(coalesce(reason, '')) as hash from (select kept_id, max(reason) as reason from merge_groups group by 1)),
b as (select id as name, sha256(max(coalesce(case when cast(right(id, 1) as int) % 2 = 0 then 'one file, one line' end, title, ''))) as hash from findings where right(id, 1) <> '3' group by 1),
i as (select id as name, sha256(max(coalesce(case when cast(right(id, 1) as int) % 2 = 0 then 'one file, one line' end, title, ''))) as hash from findings where right(id, 1) <> '4' group by 1)
select coalesce(m.name, b.name, i.name) as name, case when m.hash is null then 'UNTRACKED' when b.hash is null or i.hash is null then 'MISSING' when m.hash = b.hash and b.hash = i.hash then 'PASS' else 'DRIFT' end as verdict
from m full outer join b on m.name = b.name full outer join i on coalesce(m.name, b.name) = i.name""")
def j16_release_join(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "findings")
    shown = F.coalesce(F.when(F.right("id", F.lit(1)).cast("int") % 2 == 0, "one file, one line"), "title", F.lit(""))
    layer = lambda out: found.where(F.right("id", F.lit(1)) != out).groupBy(F.col("id").alias("name")).agg(F.sha2(F.max(shown), 256).alias("hash"))
    manifest = table(spark, folder, "merge_groups").groupBy(F.col("kept_id").alias("name")).agg(F.sha2(F.coalesce(F.max("reason"), F.lit("")), 256).alias("hash"))
    return ops.release_join(manifest, layer("3"), layer("4"))


@book.query("""with g as (select kept_id, unnest(merged_ids) as id from merge_groups) select id, min(kept_id) as survivor from g where id is not null group by 1""")
def j20_provenance(spark: SparkSession, folder: str) -> DataFrame:
    flat = table(spark, folder, "merge_groups").select("kept_id", F.explode("merged_ids").alias("id")).where("id is not null")
    return flat.groupBy("id").agg(F.min("kept_id").alias("survivor"))


@book.query("""with g as (select distinct unnest(list_append(merged_ids, kept_id)) as id from merge_groups) select id from g where id not in (select id from findings)""")
def j14_dangling_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "merge_groups").select(F.explode(F.concat("merged_ids", F.array("kept_id"))).alias("id")).distinct()
    return ids.join(table(spark, folder, "findings").select("id"), "id", "left_anti")


@book.query("""select c_mktsegment as segment, count(distinct o_orderkey) as orders, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where l_shipdate >= timestamp '1995-01-01' group by 1""")
def x3_star_join(spark: SparkSession, folder: str) -> DataFrame:
    """Star-schema smoke query: date filter and columns reach the scan, Catalyst picks the join sides."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, folder, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).select("l_orderkey", "l_extendedprice", "l_discount")  # noqa: E741
    joined = table(spark, folder, "customer").select("c_custkey", "c_mktsegment").join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_distinct("o_orderkey").alias("orders"), F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES, SQL = book.queries, book.sql
