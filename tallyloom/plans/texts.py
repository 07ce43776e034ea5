"""Queries of text functions over documents and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as fx
from tallyloom.plans.base import Book
from tallyloom.sources import table

book = Book()
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "source")


@book.query(rf"""select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') || coalesce(flatten(list_transform(regexp_extract_all(text, '{CJK}+'),
  lambda r: case when length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) end)), []) as tokens from documents""")
def t1_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", fx.tokens(F.col("text")).alias("tokens"))


@book.query(rf"""select doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as squeezed from documents""")
def t2_squeeze(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", fx.squeeze(F.col("text")).alias("squeezed"))


@book.query(r"""select symbol, lower(trim(regexp_replace(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-./]+', ' ', 'g'), '\s+', ' ', 'g'))) as words from (select distinct symbol from findings where symbol is not null)""")
def t3_split_identifier(spark: SparkSession, folder: str) -> DataFrame:
    symbols = table(spark, folder, "findings").where("symbol is not null").select("symbol").distinct()
    return symbols.select("symbol", fx.split_identifier(F.col("symbol")).alias("words"))


@book.query(r"""select symbol, list_sort(list_distinct(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-./]+', ' ', 'g'), '\s+', ' ', 'g'))), ' '),
  lambda w: length(w) >= 3 and w not in ('impl', 'get', 'set')))) as nouns from (select distinct symbol from findings where symbol is not null)""")
def t4_domain_nouns(spark: SparkSession, folder: str) -> DataFrame:
    symbols = table(spark, folder, "findings").where("symbol is not null").select("symbol").distinct()
    return symbols.select("symbol", fx.domain_nouns(F.col("symbol"), ("impl", "get", "set")).alias("nouns"))


@book.query(rf"""select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+|{CJK}')) as words from documents""")
def t9_word_count(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", fx.word_count(F.col("text")).cast("long").alias("words"))


@book.query(rf"""select doc_id, cast(ceil((length(text) - c) / 4) + ceil(c * 2 / 3) as bigint) as narrow, cast(ceil(a / 4 + (length(text) - a)) as bigint) as wide
from (select doc_id, text, len(regexp_extract_all(text, '{CJK}')) as c, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) as a from documents)""")
def t10_token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", fx.token_estimate(F.col("text")).alias("narrow"), fx.token_estimate_wide(F.col("text")).alias("wide"))


@book.query(r"""select doc_id, case when regexp_matches(lower(text), 'incident|故障') then 'incident' when regexp_matches(lower(text), 'release|发布|公開') then 'release' when regexp_matches(lower(text), 'audit|审计|監査') then 'audit' else 'other' end as topic from documents""")
def t13_first_match_class(spark: SparkSession, folder: str) -> DataFrame:
    low = F.lower("text")
    topic = F.when(low.rlike("incident|故障"), "incident").when(low.rlike("release|发布|公開"), "release").when(low.rlike("audit|审计|監査"), "audit").otherwise("other")
    return _docs(spark, folder).select("doc_id", topic.alias("topic"))


@book.query("""select doc_id, coalesce(case when contains(lower(text), 'payment') then 'payment' end, case when contains(lower(text), 'login') then 'login' end, case when contains(lower(text), 'token') then 'token' end) as keyword from documents""")
def t14_first_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", fx.first_keyword(F.col("text"), ("payment", "login", "token")).alias("keyword"))


def _redact_sql(column: str) -> str:
    for shape, mask in fx.SECRET_SHAPES:
        column = f"regexp_replace({column}, '{shape}', '{mask}', 'g')"
    return column


@book.query(f"select doc_id, sha256({_redact_sql('text')}) as masked from documents")
def t16_redaction(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.sha2(fx.redact(F.col("text")), 256).alias("masked"))


@book.query(r"""select rule_id, id, trim(regexp_replace(regexp_replace(regexp_replace(lower(q), '''[^'']*''|:[a-z_]+|\b[0-9]+\b', '?', 'g'), '\s+', ' ', 'g'), ';\s*$', '')) as sql from (
  select id, rule_id, 'SELECT *  FROM t_' || lower(category) || ' WHERE line = ' || start_line || ' AND name = ''' || coalesce(symbol, '') || '''; ' as q from findings)""")
def t19_normalised_sql(spark: SparkSession, folder: str) -> DataFrame:
    q = F.concat(F.lit("SELECT *  FROM t_"), F.lower("category"), F.lit(" WHERE line = "), F.col("start_line").cast("string"), F.lit(" AND name = '"), F.coalesce("symbol", F.lit("")), F.lit("'; "))
    return table(spark, folder, "findings").select("rule_id", "id", fx.normalised_sql(q).alias("sql"))


@book.query(r"""with l as (select doc_id, list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\S')) as l from documents)
select doc_id, len(l) as lines, len(list_filter(l, lambda x: regexp_matches(x, '^[-*] |^[0-9]+[.)] '))) as items, length(l[1]) as first_length, length(l[len(l)]) as last_length from l""")
def t22_text_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _docs(spark, folder).select("doc_id", fx.full_lines(F.col("text")).alias("l"))
    items = F.size(F.filter("l", lambda x: x.rlike(r"^[-*] |^[0-9]+[.)] ")))
    return rows.select("doc_id", F.size("l").cast("long").alias("lines"), items.cast("long").alias("items"), F.length(F.try_element_at("l", F.lit(1))).cast("long").alias("first_length"), F.length(F.try_element_at("l", F.lit(-1))).cast("long").alias("last_length"))


@book.query(r"""with l as (select doc_id, list_filter(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\S')) as l from documents)
select doc_id, case when len(l) > 0 then round(len(list_filter(l, lambda x: regexp_matches(x, '[0-9`|]|[a-z]/[a-z]'))) / len(l), 6) else 0.0 end as density from l""")
def t23_fact_density(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.round(fx.fact_density(F.col("text")), 6).alias("density"))


@book.query(r"""select doc_id, list_filter(['[A-Z]{2,}-[A-Z-]+', '[0-9]+[.,][0-9]+', '```', '[A-Za-z]+/[A-Za-z]+'], lambda p: regexp_matches(text, p)) as hits,
  len(list_filter(['[A-Z]{2,}-[A-Z-]+', '[0-9]+[.,][0-9]+', '```', '[A-Za-z]+/[A-Za-z]+'], lambda p: regexp_matches(text, p))) / 4 as coverage from documents""")
def t24_regex_battery(spark: SparkSession, folder: str) -> DataFrame:
    battery = ["[A-Z]{2,}-[A-Z-]+", "[0-9]+[.,][0-9]+", "```", "[A-Za-z]+/[A-Za-z]+"]
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(p)) for p in battery]))
    return _docs(spark, folder).select("doc_id", hits.alias("hits"), (F.size(hits) / len(battery)).alias("coverage"))


@book.query(r"""select doc_id, sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g')) as h from documents""")
def h2_normalised_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", fx.hash_lines(F.col("text")).alias("h"))


@book.query(r"""with b as (select doc_id, list_transform(string_split(text, '```'), lambda x, i: case when i % 2 = 0 then x end) as parts from documents)
select doc_id, len(list_filter(parts, lambda x: x is not null)) as blocks, coalesce(list_sum(list_transform(list_filter(parts, lambda x: x is not null), lambda x: length(x))), 0)::bigint as code_chars from b""")
def s12_fenced_blocks(spark: SparkSession, folder: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "```"), lambda x, i: F.when(i % 2 == 1, x)), lambda x: x.isNotNull())
    chars = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return _docs(spark, folder).select("doc_id", F.size(parts).cast("long").alias("blocks"), chars.alias("code_chars"))


L = r"""with l as (select doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) as n from documents)
"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", F.posexplode(fx.lines(F.col("text"))).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))


@book.query(L + r""", h as (select doc_id, n, length(regexp_extract(line, '^(#{1,6}) ', 1)) as level from l where regexp_matches(line, '^#{1,6} ')),
j as (select *, lag(level) over (partition by doc_id order by n) as before from h) select doc_id, n, before, level from j where level > before + 1""")
def w4_heading_jumps(spark: SparkSession, folder: str) -> DataFrame:
    """Headings that skip a level. A window's key is one document."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6}) ", 1)).cast("long")
    heads = _lines(spark, folder).where(F.col("line").rlike(r"^#{1,6} ")).select("doc_id", "n", level.alias("level"))
    w = Window.partitionBy("doc_id").orderBy("n")
    return heads.withColumn("before", F.lag("level").over(w)).where("level > before + 1").select("doc_id", "n", "before", "level")


@book.query(L + "select doc_id, line, count(*) as n from l where length(line) >= 12 group by 1, 2 having count(*) > 1")
def w5_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).where(F.length("line") >= 12).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@book.query(L + r""", m as (select doc_id, n, n - row_number() over (partition by doc_id order by n) as island from l where regexp_matches(line, '^\s*(?:[-*]|[0-9]+[.)]) '))
select doc_id, min(n) as first_line, max(n) as last_line, count(*) as length from m group by doc_id, island having count(*) >= 3""")
def w8_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of three or more list lines: row number difference."""
    w = Window.partitionBy("doc_id").orderBy("n")
    marked = _lines(spark, folder).where(F.col("line").rlike(r"^\s*(?:[-*]|[0-9]+[.)]) ")).withColumn("island", F.col("n") - F.row_number().over(w))
    return marked.groupBy("doc_id", "island").agg(F.min("n").alias("first_line"), F.max("n").alias("last_line"), F.count(F.lit(1)).alias("length")).where("length >= 3").drop("island")


@book.query(L + r""", d as (select doc_id, n, sum(len(regexp_extract_all(line, '\{')) - len(regexp_extract_all(line, '\}'))) over (partition by doc_id order by n) as depth from l)
select doc_id, max(depth)::bigint as deepest from d group by 1 having max(depth) > 0""")
def w10_brace_depth(spark: SparkSession, folder: str) -> DataFrame:
    delta = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _lines(spark, folder).withColumn("depth", F.sum(delta).over(w)).groupBy("doc_id").agg(F.max("depth").alias("deepest")).where("deepest > 0")


@book.query(L + r""", c as (select *, sum(case when regexp_matches(line, '^```') then 1 else 0 end) over (partition by doc_id order by n) % 2 = 1 as code from l)
select doc_id, n, rule_id from c join (values ('TODO-MARKER', 'TODO|FIXME|XXX'), ('DEBUG-RESIDUE', 'System\.out\.print|console\.log|print\('), ('UNREACHABLE', 'if ?\(false\)'), ('HARDCODED-TIME', 'currentTimeMillis|new Date\(\)'), ('SELECT-STAR', '(?i)select \*'), ('RETURN-LITERAL', 'return Math\.min')) r(rule_id, pattern) on regexp_matches(line, pattern) where code""")
def b3_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Line rules as data, applied to the lines of fenced code; each rule is one predicate in one projection."""
    rules = {"TODO-MARKER": "TODO|FIXME|XXX", "DEBUG-RESIDUE": r"System\.out\.print|console\.log|print\(", "UNREACHABLE": r"if ?\(false\)", "HARDCODED-TIME": r"currentTimeMillis|new Date\(\)", "SELECT-STAR": r"(?i)select \*", "RETURN-LITERAL": r"return Math\.min"}
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    code = F.sum(F.when(F.col("line").rlike("^```"), 1).otherwise(0)).over(w) % 2 == 1
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(r)) for r, p in rules.items()]))
    return _lines(spark, folder).withColumn("code", code).where("code").select("doc_id", "n", F.explode(hits).alias("rule_id"))


@book.query(rf"""with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as word from documents) select word, count(*) as n, count(distinct doc_id) as documents from w group by 1""")
def a26_identifier_counts(spark: SparkSession, folder: str) -> DataFrame:
    words = _docs(spark, folder).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("word"))
    per = words.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("documents"))


@book.query(r"""with b as (select doc_id, unnest(list_transform(list_filter(string_split(text, '```'), lambda x, i: i % 2 = 0), lambda x: trim(regexp_replace(regexp_replace(x, '[0-9]+', '0', 'g'), '\s+', ' ', 'g')))) as block from documents)
select block, count(distinct doc_id) as documents from b group by 1 having count(distinct doc_id) >= 3""")
def b36_duplicate_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised code blocks that stand in three or more documents."""
    blocks = F.filter(F.split("text", "```"), lambda x, i: i % 2 == 1)
    normal = F.transform(blocks, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[0-9]+", "0"), r"\s+", " ")))
    flat = _docs(spark, folder).select("doc_id", F.explode(normal).alias("block")).distinct()
    return flat.groupBy("block").agg(F.count(F.lit(1)).alias("documents")).where("documents >= 3")


@book.query("""with s as (select id, list_sort(list_distinct(string_split(lower(trim(coalesce(title, ''))), ' '))) as a, list_sort(list_distinct(string_split(lower(replace(category, '_', ' ')), ' '))) as b from findings)
select id, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) as similarity from s""")
def u3_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    a = F.array_distinct(F.split(F.lower(F.trim(F.coalesce("title", F.lit("")))), " "))
    b = F.array_distinct(F.split(F.lower(F.replace("category", F.lit("_"), F.lit(" "))), " "))
    return table(spark, folder, "findings").select("id", F.round(fx.jaccard(a, b), 6).alias("similarity"))


@book.query("""select source, lower(replace(replace(trim(source), '-', '_'), ' ', '_')) as name, case when source is null then 'none' when source = lower(source) then 'plain' else 'respelled' end as form, count(*) as n from documents group by 1, 2, 3""")
def t28_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    name = F.lower(F.translate(F.trim("source"), "- ", "__"))
    form = F.when(F.col("source").isNull(), "none").when(F.col("source") == F.lower("source"), "plain").otherwise("respelled")
    return _docs(spark, folder).groupBy("source", name.alias("name"), form.alias("form")).agg(F.count(F.lit(1)).alias("n"))


@book.query("""select o.run_key, count(distinct s) as contained from (select run_key, output, unnest(string_split(prompt, ' ')) as s from runs_r10 r join (select lower(trim(id)) as id, max(prompt) as prompt from evals group by 1) e on lower(trim(r.id)) = e.id) o where length(s) >= 8 and contains(output, s) group by 1""")
def t26_contained_words(spark: SparkSession, folder: str) -> DataFrame:
    """Long words of the prompt that an answer holds: isolation check between two texts."""
    prompts = table(spark, folder, "evals").groupBy(F.lower(F.trim("id")).alias("case")).agg(F.max("prompt").alias("prompt"))
    runs = table(spark, folder, "runs_r10").select("run_key", "output", F.lower(F.trim("id")).alias("case"))
    words = runs.join(prompts, "case").select("run_key", "output", F.explode(F.split("prompt", " ")).alias("s"))
    return words.where((F.length("s") >= 8) & F.contains("output", "s")).groupBy("run_key").agg(F.count_distinct("s").alias("contained"))


QUERIES, SQL = book.queries, book.sql
