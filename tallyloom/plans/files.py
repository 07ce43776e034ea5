"""Queries of files, ledgers, small YAML, front matter, Markdown, log lines, figures and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as fx
from tallyloom.operators import figures
from tallyloom.operators.findings import clean
from tallyloom.plans.base import Book
from tallyloom.plans.findings import C
from tallyloom.sources import files, sinks, table

book = Book()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings evals runs_r10 blind_r2_c1 baseline_metrics findings merge_groups run_ledgers tool_timings providers pack_limits mix_targets".split()


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean(table(spark, folder, "findings"))


@book.query(f"select unnest([{', '.join(repr(t) for t in TABLES)}]) as name")
def s1_file_walk(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of the data folder by a walk over its files (a table may be a file or a folder of files)."""
    return files.walk(spark, folder, (".parquet",), ("_temporary",)).select(F.regexp_extract("path", r"/([a-z0-9_]+)\.parquet", 1).alias("name")).distinct()


@book.query("select 'nation' as name, true as binary union all select 'region', true union all select 'providers', true union all select 'pack_limits', true")
def s3_binary_sniff(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the files of the fixed tables are binary; only files of up to a megabyte are opened."""
    found = files.walk(spark, folder, (".parquet",), most_bytes=1 << 20).withColumn("table", F.regexp_extract("path", r"/([a-z0-9_]+)\.parquet", 1))
    return found.where(F.col("table").isin("nation", "region", "providers", "pack_limits")).groupBy(F.col("table").alias("name")).agg(F.bool_and(files.is_binary(F.col("content"))).alias("binary"))


@book.query(r"""with d as (select doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: "' || coalesce(lang, '') || '"' || chr(10) || '---' || chr(10) || coalesce(text, '') as t, text, lang from documents)
select doc_id, doc_id::varchar as id, coalesce(lang, '') as lang, length(coalesce(text, ''))::bigint as body from d""")
def s12_front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """Front matter put before every document and read back."""
    whole = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit('\nlang: "'), F.coalesce("lang", F.lit("")), F.lit('"\n---\n'), F.coalesce("text", F.lit("")))
    parts = table(spark, folder, "documents").select("doc_id", fx.front_matter(whole).alias("f"))
    fields = fx.front_fields(F.col("f.head"))
    return parts.select("doc_id", F.try_element_at(fields, F.lit("id")).alias("id"), F.try_element_at(fields, F.lit("lang")).alias("lang"), F.length("f.body").cast("long").alias("body"))


@book.query(C + """select id as key, path, value from f, lateral (values ('rule.name', rule_id), ('rule.line', start_line::varchar), ('rule.live', case when introduced then 'true' when not introduced then 'false' end), ('sources.0', 'pmd'), ('sources.1.name', 'javac'), ('sources.1.rank', '2'), ('tags.0', 'a'), ('tags.1', 'b c')) t(path, value) where value is not null""")
def s11_yaml_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Small YAML texts made from the findings, read as leaves."""
    text = F.concat(F.lit("# head\nrule:\n  name: "), F.col("rule_id"), F.lit("  # a note\n  line: "), F.coalesce(F.col("start_line").cast("string"), F.lit("null")), F.lit("\n  live: "), F.coalesce(F.col("introduced").cast("string"), F.lit("~")), F.lit('\nsources:\n  - pmd\n  - name: javac\n    rank: 2\ntags: [a, "b c"]\n'))
    return files.read_yaml(_clean(spark, folder).select("id", text.alias("t")), "id", "t")


@book.query(C + r"""select 0 as part, null as id, '| id | title | line |' as line union all select 1, null, '|---|---|---|' union all select 2, id, '| ' || id || ' | ' || replace(regexp_replace(coalesce(title, ''), '\s*[\r\n]+\s*', ' ', 'g'), '|', '\|') || ' | ' || coalesce(start_line::varchar, '') || ' |' from f""")
def s23_markdown_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).withColumn("line", F.col("start_line"))
    return sinks.markdown_rows(rows, ["id", "title", "line"], ["id"])


@book.query(C + r"""select id, list_filter([case when symbol is null then 'symbol' end, case when title is null then 'title' end], lambda x: x is not null) as missing,
  case when symbol is not null and title is not null then '{"id":"' || id || '","symbol":"' || replace(replace(symbol, '\', '\\'), '"', '\"') || '","access_token":"***"}' end as json from f""")
def s24_checked_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines of the findings that have what is required, secrets masked."""
    return sinks.checked_lines(_clean(spark, folder).withColumn("access_token", F.col("id")), ["symbol", "title"], ["id", "symbol", "access_token"], ["id"])


#: A figure for each file: a box for each finding.
_BOXES = """b as (select file, start_line::double as x, rank * 60.0::double as y, greatest(coalesce(end_line, start_line) - start_line, 0) + 20.0::double as w, 20.0::double + rank as h from f where file is not null and start_line is not null and rank is not null),
z as (select file, count(*) as nodes, max(x + w) - min(x) as w, max(y + h) - min(y) as h, round(sum(w * h) / greatest(1.0, (max(x + w) - min(x)) * (max(y + h) - min(y))), 6) as coverage from b group by 1),
c as (select distinct file, floor(x + w / 2 + 0.5)::bigint as c from b), g as (select *, c - lag(c) over (partition by file order by c) as gap from c),
r as (select *, row_number() over (partition by file order by gap, c) - 1 as i, count(*) over (partition by file) as n from g where gap is not null),
m as (select *, max(case when i = n // 2 then gap end) over (partition by file) as m from r), i as (select file, count(*) filter (gap > 2.5 * m and n >= 2) as islands from m group by 1),
a as (select file, nodes, z.w, z.h, round(z.w / nullif(z.h, 0), 6) as ratio, coverage, coalesce(islands, 0) as islands from z left join i using (file)),
v as (select *, list_filter([case when w > 1200 then 'width' end, case when w < 240 then 'narrow' end, case when ratio < 0.25 or ratio > 4.0 then 'ratio' end, case when coverage < 0.12 then 'coverage' end, case when islands > 0 then 'islands' end], lambda x: x is not null) as codes from a)
"""


def _figures(spark: SparkSession, folder: str) -> DataFrame:
    rows = _clean(spark, folder).where("file is not null and start_line is not null and rank is not null")
    size = F.greatest(F.coalesce("end_line", "start_line") - F.col("start_line"), F.lit(0)) + 20.0
    return figures.violations(figures.measured(rows.select("file", F.col("start_line").cast("double").alias("x"), (F.col("rank") * 60.0).alias("y"), size.alias("w"), (F.col("rank") + 20.0).alias("h")), "file"))


@book.query(C + ", " + _BOXES + "select file, nodes, w, h, ratio, coverage, islands, codes from v")
def z1_figure_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _figures(spark, folder)


@book.query(C + ", " + _BOXES + r"""select figure, arg_min(file, {'p': -points, 'f': file}) as file, max(points) as points from (select regexp_extract(file, '^(.*)/[^/]*$', 1) as figure, file, round(-1000.0::double * len(codes) - greatest(w - 1200, 0) + 10 * coverage, 4) as points from v) group by 1""")
def z2_best_variant(spark: SparkSession, folder: str) -> DataFrame:
    """Of the figures of a directory the one with the most points."""
    return figures.best_variant(_figures(spark, folder).withColumn("figure", F.regexp_extract("file", "^(.*)/[^/]*$", 1)), "figure", "file")


@book.query(r"""select coalesce(repo, '(none)') as repo, count(*) as files, sum(len(string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10))))::bigint as lines, sum(length(coalesce(text, '')))::bigint as chars, max(length(coalesce(text, '')))::bigint as longest from documents group by 1""")
def z11_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, lines and characters of every repo."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, folder, "documents").groupBy(F.coalesce("repo", F.lit("(none)")).alias("repo")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(fx.lines(t))).alias("lines"), F.sum(F.length(t)).alias("chars"), F.max(F.length(t)).cast("long").alias("longest"))


@book.query(r"""with t as (select provider, status, '{"name":"' || provider || '","status":"' || coalesce(status, '') || '"}' as schema from tool_timings where provider is not null),
k as (select lower(trim(provider)) as server, schema, status = 'timeout' as slow from t) select server, count(distinct schema) as tools, sum(ceil((length(schema) - len(regexp_extract_all(schema, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]'))) / 4))::bigint as tokens, coalesce(bool_or(slow), false) as slow
from (select distinct server, schema, slow from k) group by 1""")
def z12_tool_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token cost of the distinct tool schemas of every server."""
    schema = F.concat(F.lit('{"name":"'), F.col("provider"), F.lit('","status":"'), F.coalesce("status", F.lit("")), F.lit('"}'))
    tools = table(spark, folder, "tool_timings").where("provider is not null").select(F.lower(F.trim("provider")).alias("server"), schema.alias("schema"), (F.col("status") == "timeout").alias("slow")).distinct()
    return tools.groupBy("server").agg(F.count_distinct("schema").alias("tools"), F.sum(fx.token_estimate(F.col("schema"))).alias("tokens"), F.coalesce(F.bool_or("slow"), F.lit(False)).alias("slow"))


@book.query("""with p as (select provider from providers), g as (select distinct kept_id, unnest(sources) as s from merge_groups where sources is not null), n as (select kept_id, lower(trim(s)) as name from g where s is not null),
f as (select distinct id from findings where id is not null)
select 'unknown provider' as violation, kept_id as item, count(distinct name) as n from n where name not in (select provider from p) group by 2
union all select 'unknown finding', kept_id, 1 from (select distinct kept_id from merge_groups where kept_id is not null) where kept_id not in (select id from f)
union all select 'no reason', kept_id, 1 from (select kept_id from merge_groups where kept_id is not null group by 1 having count(reason) = 0)""")
def z9_bundle_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the merge groups as a bundle: unknown providers, unknown findings, no reason."""
    groups = table(spark, folder, "merge_groups").where("kept_id is not null")
    named = table(spark, folder, "merge_groups").select("kept_id", F.explode("sources").alias("s")).where("s is not null").select("kept_id", F.lower(F.trim("s")).alias("name")).distinct()
    known = table(spark, folder, "providers").select(F.col("provider").alias("name"))
    ids = table(spark, folder, "findings").where("id is not null").select(F.col("id").alias("kept_id"))
    one = F.lit(1).cast("long")
    unknown = named.join(known, "name", "left_anti").groupBy("kept_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown provider").alias("violation"), F.col("kept_id").alias("item"), "n")
    lost = groups.select("kept_id").distinct().join(ids, "kept_id", "left_anti").select(F.lit("unknown finding").alias("violation"), F.col("kept_id").alias("item"), one.alias("n"))
    bare = groups.groupBy("kept_id").agg(F.count("reason").alias("r")).where("r = 0").select(F.lit("no reason").alias("violation"), F.col("kept_id").alias("item"), one.alias("n"))
    return unknown.unionByName(lost).unionByName(bare)


@book.query("""select count(*) as groups, count(distinct kept_id) as kept, count(*) filter (reason is null) as no_reason, count(*) filter (sources is null) as no_sources, round(avg(len(merged_ids)), 6) as mean_size, max(len(merged_ids))::bigint as largest from merge_groups""")
def a29_bundle_stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "merge_groups").agg(
        F.count(F.lit(1)).alias("groups"), F.count_distinct("kept_id").alias("kept"), F.count_if(F.col("reason").isNull()).alias("no_reason"), F.count_if(F.col("sources").isNull()).alias("no_sources"),
        F.round(F.avg(F.when(F.col("merged_ids").isNotNull(), F.size("merged_ids"))), 6).alias("mean_size"), F.max(F.size("merged_ids")).cast("long").alias("largest"),
    )


QUERIES, SQL = book.queries, book.sql
