"""Queries on findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import findings as ops
from tallyloom.operators import joins
from tallyloom.plans.base import Book
from tallyloom.sources import table

book = Book()


def _case(values: dict, column: str) -> str:
    return "case " + column + "".join(f" when '{k}' then {repr(v)}" for k, v in values.items()) + " end"


C = r"""with f0 as (select * from (select *, row_number() over (partition by id order by received_at desc) as rn from findings where id is not null) where rn = 1),
f as (
  select * exclude (rn, file, severity), regexp_replace(regexp_replace(file, '\\', '/', 'g'), '^(\./)+', '') as file,
    case when upper(trim(severity)) in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') then upper(trim(severity)) end as severity,
    case upper(trim(severity)) when 'LOW' then 0 when 'MEDIUM' then 1 when 'HIGH' then 2 when 'CRITICAL' then 3 end as rank from f0)
"""


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return ops.clean(table(spark, folder, "findings"))


@book.query(C + "select count(*) filter (severity = 'LOW') as low, count(*) filter (severity = 'MEDIUM') as medium, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'CRITICAL') as critical, max(rank) as worst_rank from f")
def a1_severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.severity_counts(_clean(spark, folder))


@book.query(C + f""", d as (select {_case(ops.DIMENSION_OF, 'category')} as dimension, severity, score_weight from f),
w as (select * from (values ('structure', 30.0::double), ('safety', 40.0), ('noise', 30.0)) v(dimension, weight)),
u as (select d.dimension, round(sum(weight * coalesce({_case(ops.SEVERITY_SHARE, 'severity')}::double, 0) * greatest(0.0, least(1.0, score_weight)) / 1000), 4) as used from d join w using (dimension) group by 1)
select dimension, coalesce(used, 0.0) as used, greatest(0.0, round(weight - coalesce(used, 0.0), 4)) as points from w left join u using (dimension)""")
def a2_dimension_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dimension_scores(_clean(spark, folder))


@book.query(C + "select id, severity, category, rank from f where severity is not null")
def a3_deductions(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each finding that costs points."""
    rows = _clean(spark, folder).where("severity is not null")
    return rows.select("id", "severity", "category", "rank")


@book.query(C + "select count(*) as findings, count(*) filter (category in ('COMPLEXITY', 'LARGE_METHOD', 'LARGE_CLASS')) as complexity, count(*) filter (category = 'DUPLICATION') as duplication, count(*) filter (category = 'DEAD_CODE') as dead_code, count(*) filter (rank >= 2) as severe, round(avg(confidence) filter (confidence between 0 and 1), 6) as confidence from f")
def a6_state_metrics(spark: SparkSession, folder: str) -> DataFrame:
    usable = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return ops.baseline_metrics(_clean(spark, folder).withColumn("confidence", usable))


@book.query(C + """, m as (select introduced, count(*) as n, count(*) filter (rank >= 2) as severe from f group by 1)
select a.n - b.n as findings_delta, a.severe - b.severe as severe_delta from m a, m b where a.introduced and not b.introduced""")
def a7_state_delta(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    sign = F.when(F.col("introduced"), 1).otherwise(-1)
    return rows.agg(F.sum(sign).alias("findings_delta"), F.sum(F.when(F.col("rank") >= 2, sign).otherwise(0)).alias("severe_delta"))


@book.query(C + """, c as (select distinct file from f where introduced),
r as (select f.id, case when list_has_any(string_split(f.file, '/'), ['tools', 'cache']) then 'excluded_path' when c.file is null then 'outside_change' end as reason from f left join c using (file))
select coalesce(reason, 'kept') as reason, count(*) as n from r group by 1""")
def f2_drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    marked = ops.drop_reasons(rows, ["tools", "cache"], rows.where("introduced"))
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@book.query(C + r"select id, file from f where regexp_matches(file, '^src/(?:[^/]+/)*[^/]*Service\.java$') or regexp_matches(regexp_extract(file, '[^/]*$'), '^[^/]*\.py$')")
def f4_glob_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    return rows.where(ops.matches_any(F.col("file"), ["src/**/*Service.java", "*.py"])).select("id", "file")


@book.query(C + """, risks as (select distinct rule_id, row_number() over (order by rule_id) as ordinal, case when cast(regexp_extract(rule_id, '[0-9]+$') as int) % 2 = 0 then date '2025-12-31' else date '2025-01-01' end as expires from (select distinct rule_id from f where regexp_matches(rule_id, '[05]$')))
select f.id, case when f.status in ('ACCEPTED_RISK', 'FIXED', 'VALIDATED') then 'closed_status' when r.rule_id is not null then 'accepted_risk' end as suppressed
from f left join risks r on f.rule_id = r.rule_id and date '2025-06-30' <= r.expires""")
def f7_suppression(spark: SparkSession, folder: str) -> DataFrame:
    """Closed status, else a live accepted risk of the rule; the day of reading is a parameter, never the clock."""
    rows = _clean(spark, folder)
    expires = F.when(F.regexp_extract("rule_id", r"([0-9]+)$", 1).cast("int") % 2 == 0, F.lit("2025-12-31")).otherwise(F.lit("2025-01-01")).cast("date")
    risks = rows.where(F.col("rule_id").rlike("[05]$")).select("rule_id").distinct().withColumn("expires", expires)
    live = risks.where(F.col("expires") >= F.lit("2025-06-30").cast("date")).select("rule_id", F.lit("accepted_risk").alias("risk"))
    reason = F.when(F.col("status").isin(*ops.CLOSED), "closed_status").otherwise(F.col("risk"))
    return rows.join(live, "rule_id", "left").select("id", reason.alias("suppressed"))


@book.query(C + r"""select id, unnest(list_filter([
  case when severity is null then 'SCHEMA-001' end, case when not coalesce(confidence >= 0 and confidence <= 1, false) then 'SCHEMA-002' end,
  case when coalesce(end_line < start_line, true) then 'SCHEMA-003' end, case when coalesce(len(sources), 0) <= 0 then 'SCHEMA-004' end,
  case when coalesce(length(trim(title)), 0) = 0 then 'SCHEMA-005' end], lambda x: x is not null)) as code from f""")
def f17_schema_violations(spark: SparkSession, folder: str) -> DataFrame:
    return ops.violations(_clean(spark, folder))


@book.query(C + """, p as (select path, min(id) as position from (select id, 'repo/' || file as path from f where introduced) group by 1),
m as (select f.id, first(p.path order by p.position) as matched from f left join p on p.path = f.file or suffix(p.path, '/' || f.file) group by 1) select id, matched from m""".replace("suffix(p.path, '/' || f.file)", "ends_with(p.path, '/' || f.file)"))
def j1_suffix_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    paths = rows.where("introduced").groupBy(F.concat(F.lit("repo/"), "file").alias("path")).agg(F.min("id").alias("position"))
    return joins.suffix_lookup(rows, paths).select("id", "matched")


H = """, h as (select file, low, low + 149 as high from (select distinct file, (length(file) * 5) % 300 as low from f))
"""


def _hunks(rows: DataFrame) -> DataFrame:
    low = (F.length("file") * 5) % 300
    return rows.select("file").distinct().select("file", low.alias("low"), (low + 149).alias("high"))


@book.query(C + H + "select f.id from f where exists (select 1 from h where h.file = f.file and f.start_line between h.low and h.high)")
def j2_lines_in_hunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    return joins.in_intervals(rows, _hunks(rows), "file", "start_line").select("id")


K = """, o as (select distinct rule_id, file, start_line, symbol from f where historical), n as (select distinct rule_id, file, start_line, symbol from f where introduced)
"""


@book.query(C + K + """, z as (select *, 1 as o, 0 as n from o union all select *, 0, 1 from n)
select change, count(*) as n from (select case when max(o) = 1 and max(n) = 1 then 'kept' when max(o) = 1 then 'closed' else 'appeared' end as change from z group by rule_id, file, start_line, symbol) group by 1""")
def j3_baseline_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    keys = ["rule_id", "file", "start_line", "symbol"]
    return joins.compare(rows.where("historical"), rows.where("introduced"), keys).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@book.query(C + K + "select id from f where introduced and not exists (select 1 from o where o.rule_id = f.rule_id and o.file = f.file and o.start_line = f.start_line and o.symbol is not distinct from f.symbol)")
def j3_new_findings(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder)
    keys = ["rule_id", "file", "start_line", "symbol"]
    old = rows.where("historical").select(*keys)
    new = rows.where("introduced")
    return new.join(old, joins.null_safe(new, old, keys), "left_anti").select("id")


@book.query(C + """, t as (select rule_id as item, list(distinct file order by file) as members from f group by 1), u as (select item, unnest(members) as m from t)
select a.item as a, b.item as b, count(*) as shared from u a join u b on a.m = b.m and a.item < b.item group by 1, 2 having count(*) >= 2""")
def j5_overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that share at least two files."""
    return joins.shared_members(_clean(spark, folder), "rule_id", "file", 2)


@book.query(C + """, e as (select id, coalesce(sources, []) as s from f), x as (select id, unnest(s) as s from e)
select s as source, count(distinct id) as findings from x group by 1""")
def j6_inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    flat = _clean(spark, folder).select("id", F.explode("sources").alias("source")).distinct()
    return flat.groupBy("source").agg(F.count(F.lit(1)).alias("findings"))


@book.query(C + "select file from f where category in ('DEAD_CODE', 'DUPLICATION', 'DATABASE', 'CONCURRENCY') group by 1 having count(distinct category) = 4")
def j18_complete_files(spark: SparkSession, folder: str) -> DataFrame:
    return joins.complete(_clean(spark, folder), "file", "category", ["DEAD_CODE", "DUPLICATION", "DATABASE", "CONCURRENCY"])


@book.query(C + """, k as (select unnest([rule_id, category]) as key, id from f) select key, min(id) as id from k where key is not null group by 1""")
def j15_first_binding(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).withColumn("position", F.col("id"))
    return joins.first_binding(rows, ["rule_id", "category"], "id", "position")


@book.query(C + """, s as (select rule_id as id, min(category) as category, max(rank) >= 2 as live, list(distinct regexp_extract(file, '^[^/]*/[^/]*') order by regexp_extract(file, '^[^/]*/[^/]*')) as tags, min(id) as position from f group by 1),
x as (select id, category, unnest(tags) as m from s), o as (select id, category, position, unnest(tags) as m from s where live),
h as (select x.id, o.id as other, o.position from x join o on x.category = o.category and x.m = o.m and x.id <> o.id)
select s.id, first(h.other order by h.position, h.other) as replacement from s left join h using (id) group by 1""")
def j11_replacement(spark: SparkSession, folder: str) -> DataFrame:
    rules = _clean(spark, folder).groupBy(F.col("rule_id").alias("id")).agg(
        F.min("category").alias("category"), F.coalesce(F.max("rank") >= 2, F.lit(False)).alias("live"), F.collect_set(F.regexp_extract("file", "^[^/]*/[^/]*", 0)).alias("tags"), F.min("id").alias("position")
    )
    return joins.with_replacement(rules, ["category"], "tags", "position").select("id", "replacement")


@book.query(C + "select id, row_number() over (partition by file order by rank desc nulls last, start_line, end_line, id) as place from f")
def o1_report_order(spark: SparkSession, folder: str) -> DataFrame:
    return ops.report_order(_clean(spark, folder)).select("id", F.col("place").cast("long").alias("place"))


@book.query(C + "select id from f order by rank desc nulls last, case when isnan(confidence) then null else confidence end desc nulls last, id limit 100")
def o2_best_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence")))
    return ops.top_findings(rows, 100).select("id")


@book.query(C + "select id from (select id, row_number() over (partition by rule_id, file order by start_line, id) as n from f) where n <= 2")
def o9_capped_per_rule(spark: SparkSession, folder: str) -> DataFrame:
    """At most two findings of a rule in a file: the cap is the operator."""
    from pyspark.sql import Window

    w = Window.partitionBy("rule_id", "file").orderBy("start_line", "id")
    return _clean(spark, folder).withColumn("n", F.row_number().over(w)).where("n <= 2").select("id")


@book.query(C + "select file, start_line, count(distinct severity) as severities, max(rank) as worst, count(*) as n from f group by 1, 2 having count(distinct severity) >= 2 and max(rank) >= 2")
def w12_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.conflicts(_clean(spark, folder))


@book.query(C + "select id, 'F-' || lpad(cast(row_number() over (partition by rule_id order by file, start_line, id) as varchar), 6, '0') as seq_id from f")
def w2_sequential_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers after sorting, by rule, so that no task sorts all findings."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("rule_id").orderBy("file", "start_line", "id"))
    return _clean(spark, folder).select("id", F.concat(F.lit("F-"), F.lpad(n.cast("string"), 6, "0")).alias("seq_id"))


@book.query(C + f"select {_case(ops.LANGUAGE_OF, 'regexp_extract(file, ' + chr(39) + '[^.]*$' + chr(39) + ')')} as language, count(*) as n from f group by 1")
def t30_languages(spark: SparkSession, folder: str) -> DataFrame:
    language = ops.lookup(ops.LANGUAGE_OF, F.regexp_extract("file", r"[^.]*$", 0))
    return _clean(spark, folder).groupBy(language.alias("language")).agg(F.count(F.lit(1)).alias("n"))


@book.query(C + r"select regexp_replace(f0.file, '^[./]+', '') as all_stripped, regexp_replace(f0.file, '^(\./)+', '') as current_stripped, count(*) as n from f0 group by 1, 2")
def s1_path_forms(spark: SparkSession, folder: str) -> DataFrame:
    rows = ops.latest(table(spark, folder, "findings"))
    return rows.groupBy(ops.strip_all(F.col("file")).alias("all_stripped"), ops.strip_current(F.col("file")).alias("current_stripped")).agg(F.count(F.lit(1)).alias("n"))


@book.query(C + """, k as (select rule_id, file, count(*) as n from f group by 1, 2) select rule_id, round(sum(n * n)::double / (sum(n) * sum(n)), 9) as concentration, sum(n)::bigint as total from k group by 1""")
def x4_concentration(spark: SparkSession, folder: str) -> DataFrame:
    cells = _clean(spark, folder).groupBy("rule_id", "file").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("rule_id").agg(F.round(F.sum(F.col("n") * F.col("n")).cast("double") / (F.sum("n") * F.sum("n")), 9).alias("concentration"), F.sum("n").alias("total"))


@book.query(C + """, e as (select id, category, severity from f) pivot (select category, severity from e where severity is not null) on severity in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') using count(*) group by category""")
def r6_pivot(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).where("severity is not null")
    return rows.groupBy("category").pivot("severity", ["LOW", "MEDIUM", "HIGH", "CRITICAL"]).agg(F.count(F.lit(1))).na.fill(0)


@book.query(C + """select category, severity, cast(grouping(category) * 2 + grouping(severity) as int) as level, count(*) as n from f group by rollup (category, severity)""")
def a24_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder).rollup("category", "severity").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


@book.query(C + r"""select sha256(string_agg(line, chr(10) order by line)) as tree_hash, sum(n)::bigint as files from (select regexp_extract(file, '^(.*)/[^/]*$', 1) || ':' || sha256(string_agg(line, chr(10) order by line)) as line, count(*) as n
  from (select file, file || ':' || hex(bit_xor(h)) as line from (select file, ('0x' || substr(sha256(id), 1, 15))::bigint as h from f where file is not null) group by file) group by regexp_extract(file, '^(.*)/[^/]*$', 1))""".replace("hex(bit_xor(h))", "bit_xor(h)"))
def a30_tree_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of a tree in two levels: the sorted path:hash lines of a directory, then those of the directories. A file's own
    hash is an order-free sum of its findings' hashes, so no task gathers more than a directory's lines."""
    part = F.conv(F.substring(F.sha2("id", 256), 1, 15), 16, 10).cast("long")
    lines = _clean(spark, folder).where("file is not null").groupBy("file").agg(F.bit_xor(part).alias("h"))
    return ops.tree_hash(lines, "file", "h")


@book.query(C + """select case when rank >= 3 then 'block' when rank = 2 then 'review' when rank = 1 then 'watch' else 'pass' end as tier, count(*) as n, round(avg(case when confidence between 0 and 1 then confidence end), 6) as confidence from f group by 1""")
def g6_risk_tiers(spark: SparkSession, folder: str) -> DataFrame:
    tier = F.when(F.col("rank") >= 3, "block").when(F.col("rank") == 2, "review").when(F.col("rank") == 1, "watch").otherwise("pass")
    usable = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return _clean(spark, folder).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(usable), 6).alias("confidence"))


QUERIES, SQL = book.queries, book.sql
