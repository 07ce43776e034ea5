"""Queries of redaction, paths, selections, windows of text, symbols and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import paths, redaction
from tallyloom.functions import text as fx
from tallyloom.operators import codefacts, selection
from tallyloom.operators.findings import clean, glob_to_regex, handoff, hunk_reasons
from tallyloom.plans.base import Book
from tallyloom.plans.findings import C
from tallyloom.sources import table

book = Book()


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return clean(table(spark, folder, "findings"))


def _fields() -> F.Column:
    return F.create_map(F.lit("api_key"), F.col("id"), F.lit("result_tokens"), F.col("start_line").cast("string"), F.lit("Authorization"), F.lit("x"), F.lit("note"), F.concat(F.lit("bearer "), F.coalesce("symbol", F.lit("nosuchname"))), F.lit("title"), F.coalesce("title", F.lit("")))


_V = "select id, k, v from f, lateral (values ('api_key', id), ('result_tokens', start_line::varchar), ('Authorization', 'x'), ('note', 'bearer ' || coalesce(symbol, 'nosuchname')), ('title', coalesce(title, ''))) t(k, v)"


@book.query(C + f", v as ({_V}) select id, k as field, case when regexp_matches(k, '(?i)token|key|secret|password|passwd|authorization|cookie|credential') and k not in ('context_tokens_loaded', 'result_tokens') then '***' else regexp_replace(v, '(?i)\\bbearer\\s+[A-Za-z0-9._\\-]{{8,}}', '***', 'g') end as shown from v")
def t15_masked_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder).select("id", F.explode(redaction.masked_fields(_fields())).alias("field", "shown"))


_B64 = "list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z0-9+/]{40,}={0,2}')), lambda x: regexp_matches(x, '[A-Z]') and regexp_matches(x, '[a-z]') and regexp_matches(x, '[0-9+/=]'))"


@book.query(r"""with o as (select run_key, text from (select run_key, coalesce(output, '') as text, row_number() over (partition by run_key order by received_at desc, coalesce(output, '') desc) as rn from runs_r10 where run_key is not null) where rn = 1)
select run_key, sha256(list_reduce(list_prepend(text, list_sort(__B64__, 'DESC')), lambda a, x: replace(a, x, '***'))) as masked, len(__B64__) as codes from o""".replace("__B64__", _B64))
def t16_value_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Long codes in answers masked by their shape; digests stay."""
    rows = table(spark, folder, "runs_r10").where("run_key is not null").groupBy("run_key").agg(F.max(F.struct("received_at", F.coalesce("output", F.lit("")).alias("t"))).alias("r")).select("run_key", F.col("r.t").alias("t"))
    codes = F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(redaction.LONG_CODE), F.lit(0))))
    return rows.select("run_key", F.sha2(redaction.masked_values(F.col("t")), 256).alias("masked"), codes.cast("long").alias("codes"))


_KIND = rf"""case when regexp_matches(file, '{paths.TESTS}') then 'test' when regexp_matches(file, '{paths.CONFIGS}') then 'config' when regexp_matches(file, '{paths.RULES}') then 'rule' when regexp_matches(file, '{paths.DOCUMENTS}') then 'document' else 'source' end"""
_PATHS = "p0 as (select distinct file from f where file is not null), p as (select file from p0 union all select 'docs/' || file from p0 union all select regexp_replace(file, '\\.[a-z]+$', '.spec.ts') from p0 union all select 'build/' || file from p0 union all select regexp_replace(file, '[^/]+$', 'application-dev.yml') from p0 union all select file || '.md' from p0)"


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    one = F.col("file")
    more = F.array(one, F.concat(F.lit("docs/"), one), F.regexp_replace(one, r"\.[a-z]+$", ".spec.ts"), F.concat(F.lit("build/"), one), F.regexp_replace(one, "[^/]+$", "application-dev.yml"), F.concat(one, F.lit(".md")))
    return _clean(spark, folder).where("file is not null").select("file").distinct().select(F.explode(more).alias("file"))


@book.query(C + f", {_PATHS} select {_KIND} as kind, ({' or '.join(f'regexp_matches(file, {chr(39)}{p}{chr(39)})' for p in paths.GENERATED)}) as made, count(*) as n from p group by 1, 2")
def f13_path_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """What every path is, and whether it is generated (F-5)."""
    return _paths(spark, folder).groupBy(paths.path_kind(F.col("file")).alias("kind"), paths.is_generated(F.col("file")).alias("made")).agg(F.count(F.lit(1)).alias("n"))


@book.query(C + rf"select file, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(file, '^.*/', ''), '(?i)\.[a-z0-9]+$', ''), '{paths.ROLES}', ''), '[_\-\s.]', '', 'g')) as module from (select distinct file from f where file is not null)")
def t21_module_names(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder).where("file is not null").select("file").distinct().select("file", paths.module_name(F.col("file")).alias("module"))


L = r"""with l as (select doc_id, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1) as n from documents)
"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.posexplode(fx.lines(F.col("text"))).alias("n", "line")).withColumn("n", (F.col("n") + 1).cast("long"))


@book.query(L + r"""select doc_id, n, case when regexp_matches(line, '^[ \t]*@[A-Za-z0-9_]*applyGate\b') then 'annotation' when regexp_matches(line, '^[ \t]*(?:import|export|from|require|using|package)\b') then 'import'
  when regexp_matches(line, '\b(?:forName|getMethod|getDeclaredMethod|loadClass|getBean|ServiceLoader|import|require|context)\b') then 'reflection' when regexp_matches(line, '\bapplyGate[ \t]*\(') then 'call' else 'text' end as kind from l where contains(line, 'applyGate')""")
def t29_reference_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).where(F.contains("line", F.lit("applyGate"))).select("doc_id", "n", paths.reference_kind(F.col("line"), "applyGate").alias("kind"))


@book.query(L + """, h as (select *, row_number() over (partition by doc_id order by n) as i from l where contains(line, 'applyGate')) select h.doc_id, h.n as hit, l.n from h join l on l.doc_id = h.doc_id and l.n between h.n - 8 and h.n + 8 where i <= 5""")
def w11_near_hits(spark: SparkSession, folder: str) -> DataFrame:
    return selection.near_hits(_lines(spark, folder), "doc_id", "n", "line", "applyGate")


@book.query(L + r""", m as (select doc_id, n, n - row_number() over (partition by doc_id order by n) as island from l where regexp_matches(line, '^\s*(?://|/\*|\*|#)'))
select doc_id, min(n) as first_line, max(n) as last_line, count(*) as length from m group by doc_id, island having count(*) >= 5""")
def w8_comment_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Five or more lines in a row that open like comments."""
    from pyspark.sql import Window

    marked = _lines(spark, folder).where(F.col("line").rlike(r"^\s*(?://|/\*|\*|#)")).withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n")))
    return marked.groupBy("doc_id", "island").agg(F.min("n").alias("first_line"), F.max("n").alias("last_line"), F.count(F.lit(1)).alias("length")).where("length >= 5").drop("island")


@book.query(r"""with d as (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as l from documents where text is not null), w as (select *, least(4, len(l)) as b from d where len(l) >= 2)
select doc_id, list_slice(l, 1, b) || case when len(l) > b then ['... [' || (len(l) - b) || ' lines elided] ...'] else [] end as shown from w""")
def t25_windowed(spark: SparkSession, folder: str) -> DataFrame:
    """The lines around line 2 of each document, and a mark for the others."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", fx.lines(F.col("text")).alias("l")).where(F.size("l") >= 2)
    return rows.select("doc_id", fx.windowed(F.col("l"), F.array(F.struct(F.lit(2).alias("low"), F.lit(2).alias("high"))), 2).alias("shown"))


@book.query(r"""with l as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as n from (select doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as l from documents where text is not null)),
c as (select *, sum(strlen(line) + 1) over (partition by doc_id order by n) as used from l)
select doc_id, count(*) filter (used <= 300) as kept, case when max(used) > 300 then 1 else 0 end::bigint as marks from c group by 1""")
def t25_byte_budget(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each document fit into 300 bytes, and whether the cut is marked."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", fx.cut_to_bytes(fx.lines(F.col("text")), 300).alias("l"))
    marks = F.when(F.try_element_at("l", F.lit(-1)) == "... [truncated at 300 bytes] ...", 1).otherwise(0)
    return rows.select("doc_id", (F.size("l") - marks).cast("long").alias("kept"), marks.cast("long").alias("marks"))


_SENT = r"list_filter(list_transform(string_split_regex(prompt, '[.!?。！？\n]+'), lambda s: trim(s)), lambda s: length(s) >= 20)"


@book.query(r"""with r as (select run_key, lower(trim(id)) as id, coalesce(output, '') as output from (select *, row_number() over (partition by run_key order by received_at desc, coalesce(output, '') desc, id desc) as rn from runs_r10 where run_key is not null) where rn = 1), e as (select lower(trim(id)) as id, max(prompt) as prompt from evals group by 1)
select run_key from r join e using (id) where len(list_filter(__S__, lambda s: contains(output, s) or contains(lower(trim(regexp_replace(output, '\s+', ' ', 'g'))), lower(trim(regexp_replace(s, '\s+', ' ', 'g')))))) > 0""".replace("__S__", _SENT))
def t26_shared_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that hold a sentence of twenty characters or more of their prompt."""
    prompts = table(spark, folder, "evals").groupBy(F.lower(F.trim("id")).alias("case")).agg(F.max("prompt").alias("prompt"))
    runs = table(spark, folder, "runs_r10").where("run_key is not null").groupBy("run_key").agg(F.max(F.struct("received_at", F.coalesce("output", F.lit("")).alias("o"), "id")).alias("r")).select("run_key", F.col("r.o").alias("o"), F.lower(F.trim("r.id")).alias("case"))
    return runs.join(prompts, "case").where(fx.shared_sentence(F.col("prompt"), F.col("o"))).select("run_key")


_COND = """'if (line > ' || start_line || ' && name == "' || coalesce(symbol, '') || '" && kind.equals(''' || category || '''))  '"""
_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(q, '\s+', ' ', 'g')), '"(?:\\.|[^"\\])*"', 'STR', 'g'), '''(?:\\.|[^''\\])*''', 'STR', 'g'), '\b[0-9]+(?:\.[0-9]+)?[fFdDlL]?\b', 'NUM', 'g'))"""


@book.query(C + f", q as (select id, rule_id, file, {_COND} as q from f where file is not null and category is not null) select id, {_NORM} as cond from q")
def t20_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return _conditions(spark, folder).select("id", "cond")


def _conditions(spark: SparkSession, folder: str) -> DataFrame:
    q = F.concat(F.lit("if (line > "), F.col("start_line").cast("string"), F.lit(' && name == "'), F.coalesce("symbol", F.lit("")), F.lit('" && kind.equals(\''), F.col("category"), F.lit("'))  "))
    return _clean(spark, folder).where("file is not null and category is not null").select("id", "file", "category", fx.normalised_condition(q).alias("cond"), fx.normalised_sql(F.concat(F.lit("SELECT * FROM t_"), F.lower("category"), F.lit(" WHERE line = "), F.col("start_line").cast("string"))).alias("sql"))


@book.query(C + f", q as (select id, file, {_COND} as q from f where file is not null and category is not null), c as (select distinct file, {_NORM} as cond from q) select cond, count(*) as files, min(file) as first from c group by 1 having count(*) >= 3")
def b42_shared_conditions(spark: SparkSession, folder: str) -> DataFrame:
    """The same normalised condition in three or more files."""
    return codefacts.shared_texts(_conditions(spark, folder), "file", "cond", 3)


@book.query(C + r""", s as (select distinct file, 'select * from t_' || regexp_replace(lower(category), '\b[0-9]+\b', '?', 'g') || ' where line = ?' as sql from f where file is not null and category is not null) select sql, count(*) as files, min(file) as first from s group by 1 having count(*) >= 3""")
def b36_shared_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The same normalised SQL in three or more files."""
    return codefacts.shared_texts(_conditions(spark, folder), "file", "sql", 3)


_STATEMENT = """case when category = 'DATABASE' then 'DELETE from t_' || start_line when category = 'PERFORMANCE' then 'update t_x set a = ' || start_line || case when introduced then ' where id = 1' else '' end when category = 'CONCURRENCY' then 'delete from ${t}' else 'select 1' end"""


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    s = (
        F.when(F.col("category") == "DATABASE", F.concat(F.lit("DELETE from t_"), F.col("start_line").cast("string")))
        .when(F.col("category") == "PERFORMANCE", F.concat(F.lit("update t_x set a = "), F.col("start_line").cast("string"), F.when(F.col("introduced"), " where id = 1").otherwise("")))
        .when(F.col("category") == "CONCURRENCY", "delete from ${t}").otherwise("select 1")
    )
    return _clean(spark, folder).where("category is not null and start_line is not null").select("id", "introduced", s.alias("literal"))


@book.query(C + f", s as (select id, {_STATEMENT} as literal from f where category is not null and start_line is not null) select id, case when regexp_matches(literal, '(?i)^update') then 'UPDATE-NO-WHERE' else 'DELETE-NO-WHERE' end as rule, literal from s where regexp_matches(literal, '(?i)^(update|delete)') and not regexp_matches(literal, '(?i)\\bwhere\\b') and not contains(literal, '${{')")
def b31_open_statements(spark: SparkSession, folder: str) -> DataFrame:
    return codefacts.open_statements(_statements(spark, folder), "id", "literal")


@book.query(C + f", s as (select id, introduced, {_STATEMENT} as literal from f where category is not null and start_line is not null) select id, case when regexp_matches(literal, '(?i)^update') then 'UPDATE-NO-WHERE' else 'DELETE-NO-WHERE' end as rule, literal from s where regexp_matches(literal, '(?i)^(update|delete)') and not regexp_matches(literal, '(?i)\\bwhere\\b') and not contains(literal, '${{')")
def b32_mapper_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The same rules on the statements of a mapper file."""
    tag = F.when(F.lower("literal").startswith("update"), "update").otherwise("delete")
    xml = F.concat(F.lit("<mapper>\n<"), tag, F.lit(' id="s1">\n'), F.col("literal"), F.lit("\n</"), tag, F.lit(">\n<"), tag, F.lit(' id="s2"> delete from x <where> id = 1 </where></'), tag, F.lit(">\n</mapper>"))
    found = codefacts.mapper_statements(_statements(spark, folder).where("literal != 'select 1'").select(F.col("id").alias("key"), xml.alias("xml")), "key", "xml")
    return codefacts.open_statements(found, "key", "literal").withColumnRenamed("key", "id")


def _code(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("code"))


def _symbols_sql() -> str:
    cells = " || ".join(f"list_transform(regexp_extract_all(code, '{p.replace(chr(39), chr(39) * 2)}', 1), lambda n: {{'language': '{language}', 'kind': '{kind}', 'name': n}})" for language, kind, p in codefacts.SYMBOLS)
    return f"with d as (select doc_id, coalesce(text, '') as code from documents), y as (select doc_id, unnest({cells}) as s from d), s as (select doc_id, s.language as language, s.kind as kind, s.name as name from y)\n"


@book.query(_symbols_sql() + "select doc_id, language, kind, name from s")
def v11_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return codefacts.symbols(_code(spark, folder), "doc_id", "code")


@book.query(_symbols_sql() + "select language, kind, grouping_id(language, kind)::int as level, count(*) as n, count(distinct name) as names from s group by grouping sets ((language), (kind), (language, kind))")
def a25_symbol_stats(spark: SparkSession, folder: str) -> DataFrame:
    return codefacts.symbol_stats(codefacts.symbols(_code(spark, folder), "doc_id", "code"))


@book.query(_symbols_sql() + r""", m as (select distinct name from s where kind = 'method'), u as (select doc_id, unnest(regexp_extract_all(code, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) as name from d)
select m.name, count(distinct u.doc_id) as callers, count(u.name) as calls from m left join u using (name) group by 1""")
def j19_callers(spark: SparkSession, folder: str) -> DataFrame:
    """Declared methods and how many texts call them."""
    code = _code(spark, folder)
    return codefacts.calls(code, "doc_id", "code", codefacts.symbols(code, "doc_id", "code").where("kind = 'method'"))


@book.query(r"""select doc_id, list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '"((?:\\.|[^"\\\n])*)"', 1))) as literals from documents""")
def a27_literals(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct string literals of each text, sorted."""
    return _code(spark, folder).select("doc_id", codefacts.literals(F.col("code")).alias("literals"))


_REASON = "case when severity = 'CRITICAL' then 'gate' when introduced then 'changed' when coalesce(historical, false) then 'history' else 'reference' end"
_PRIORITY = "case when severity = 'CRITICAL' then 0 when introduced then 1 when coalesce(historical, false) then 3 else 2 end"


def _reasons(spark: SparkSession, folder: str) -> DataFrame:
    critical, old = F.col("severity") == "CRITICAL", F.coalesce("historical", F.lit(False))
    reason = F.when(critical, "gate").when(F.col("introduced"), "changed").when(old, "history").otherwise("reference")
    priority = F.when(critical, 0).when(F.col("introduced"), 1).when(old, 3).otherwise(2)
    return _clean(spark, folder).where("file is not null").select("id", "file", "severity", reason.alias("reason"), priority.alias("priority"))


@book.query(C + f", p as (select file, min({_PRIORITY}) as priority from f where file is not null group by 1) select file, case priority when 0 then 'gate' when 1 then 'changed' when 2 then 'reference' else 'history' end as reason, priority from p order by priority, file limit 60")
def o5_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    """The sixty most urgent files: the feature is the cap."""
    return selection.by_priority(_reasons(spark, folder), "file", "reason", "priority", 60)


@book.query(C + f""", p as (select id, severity, case {_REASON} when 'gate' then 'tests' when 'changed' then 'refs' when 'history' then 'config' else 'callees' end as kind from f where file is not null and severity is not null),
k as (select *, row_number() over (partition by severity, kind order by id) as i, case severity when 'LOW' then 0 when 'MEDIUM' then case kind when 'refs' then 40 when 'callees' then 20 else 0 end when 'HIGH' then case kind when 'refs' then 60 when 'callees' then 30 else 4 end else case kind when 'refs' then 80 when 'callees' then 40 else 6 end end as cap from p)
select id, severity, kind from k where i <= cap""")
def o6_within_caps(spark: SparkSession, folder: str) -> DataFrame:
    """What the caps of each risk level take of each kind."""
    kind = F.when(F.col("reason") == "gate", "tests").when(F.col("reason") == "changed", "refs").when(F.col("reason") == "history", "config").otherwise("callees")
    rows = _reasons(spark, folder).where("severity is not null").select("id", "severity", kind.alias("kind"))
    return selection.within_caps(rows, "severity", "kind", ["id"])


@book.query(r"""select doc_id, size from (select doc_id, cast(ceil((length(text) - c) / 4) + ceil(c * 2 / 3) as bigint) as size from (select doc_id, text, len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')) as c from documents)) where size > 400""")
def o7_over_budget(spark: SparkSession, folder: str) -> DataFrame:
    return selection.over_budget(table(spark, folder, "documents"), "doc_id", fx.token_estimate(F.col("text")), 400)


@book.query(C + "select id, list_slice(sources, 1, 2) as shown, greatest(coalesce(len(sources), 0) - 2, 0)::bigint as left_out from f where sources is not null")
def o10_truncated(spark: SparkSession, folder: str) -> DataFrame:
    """The first two sources and how many are left out."""
    return _clean(spark, folder).where("sources is not null").select("id", F.slice("sources", 1, 2).alias("shown"), F.greatest(F.size("sources") - 2, F.lit(0)).cast("long").alias("left_out"))


@book.query(C + """select 'finding' as kind, id, title as claim, status from f union all select 'run', run_id, gate, mode from run_ledgers union all select 'repo', repo, snapshot_no::varchar, warnings::varchar from baseline_metrics""")
def u2_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Findings, runs and snapshots as one kind of record."""
    return selection.evidence(
        (_clean(spark, folder), "finding", F.col("id"), F.col("title"), F.col("status")),
        (table(spark, folder, "run_ledgers"), "run", F.col("run_id"), F.col("gate"), F.col("mode")),
        (table(spark, folder, "baseline_metrics"), "repo", F.col("repo"), F.col("snapshot_no"), F.col("warnings")),
    )


_DEDUP = "list_filter(x, lambda v, i: list_position(x, v) = i)"


@book.query(C + f"select id, {_DEDUP} as names from (select id, list_filter(coalesce(sources, []), lambda s: s is not null) || string_split(lower(category), '_') || ['reviewer', 'code'] as x from f where category is not null)")
def u5_union_in_order(spark: SparkSession, folder: str) -> DataFrame:
    names = F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda s: s.isNotNull())
    return _clean(spark, folder).where("category is not null").select("id", selection.union_in_order(names, F.split(F.lower("category"), "_"), F.array(F.lit("reviewer"), F.lit("code"))).alias("names"))


@book.query("""with l as (select * from (select *, row_number() over (partition by run_id order by received_at desc) as rn from run_ledgers where run_id is not null) where rn = 1)
select run_id, substr(sha256('{"repo":"' || repo || '","mode":"' || coalesce(mode, '') || '","calls":' || coalesce(llm_calls, -1) || '}'), 1, 16) as stable_id, sha256(concat_ws(chr(0), 'v1', repo, coalesce(mode, ''), 'salt')) as cache_key from l""")
def h3_run_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Run ids from the stable JSON of what a run is about, and the key its results are cached under (S-26)."""
    rows = table(spark, folder, "run_ledgers").where("run_id is not null").groupBy("run_id").agg(F.max_by(F.struct("repo", "mode", "llm_calls"), "received_at").alias("r")).select("run_id", "r.*")
    stable = F.to_json(F.struct("repo", F.coalesce("mode", F.lit("")).alias("mode"), F.coalesce("llm_calls", F.lit(-1)).alias("calls")))
    return rows.select("run_id", F.substring(F.sha2(stable, 256), 1, 16).alias("stable_id"), F.sha2(F.concat_ws("\u0000", F.lit("v1"), "repo", F.coalesce("mode", F.lit("")), F.lit("salt")), 256).alias("cache_key"))


@book.query(C + """, v as (select kept_id as id, max_by(reason, merged_at) as verdict from (select * from merge_groups where reason is not null) group by 1) select id, coalesce(verdict, status) as outcome from f left join v using (id)""")
def j8_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with the reason they were merged for, or their own status."""
    verdicts = table(spark, folder, "merge_groups").where("reason is not null").select(F.col("kept_id").alias("id"), F.col("reason").alias("verdict"), F.col("merged_at").alias("at"))
    return selection.with_verdict(_clean(spark, folder), verdicts, "id").select("id", "outcome")


RISKS = (("old", None, "CHM-*", "2020-01-01"), ("one", "CHM-000000007", None, "2099-01-01"), ("dead code", None, "CHM-DEAD-*", "2099-01-01"), ("any tenth", None, "CHM-*-1?", "2099-01-01"))


@book.query(C + r"select id, case when id = 'CHM-000000007' then 'one' when regexp_matches(rule_id, '^CHM-DEAD-[^/]*$') then 'dead code' when regexp_matches(rule_id, '^CHM-[^/]*-1[^/]$') then 'any tenth' end as risk from f")
def j10_accepted_risks(spark: SparkSession, folder: str) -> DataFrame:
    """The first live accepted risk that fits a finding by id or by a glob of its rule (F-6)."""
    return selection.accepted_risk(_clean(spark, folder), RISKS, "2025-06-01", glob_to_regex).select("id", "risk")


@book.query(C + """, h as (select file, min(start_line) + 100 as low, min(start_line) + 400 as high from f where file is not null and introduced and severity in ('HIGH', 'LOW') group by 1),
c as (select distinct file from f where introduced and file is not null) select id, case when list_contains(string_split(file, '/'), 'tools') then 'excluded_path' when file is null or file not in (select file from c) then 'outside_change'
  when file in (select file from h) and not exists (select 1 from h where h.file = f.file and f.start_line between h.low and h.high) then 'outside_hunk' end as reason from f""")
def f2_hunk_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why findings are dropped, with the hunks of changed files."""
    rows = _clean(spark, folder)
    changed = rows.where("introduced and file is not null")
    hunks = changed.where("severity in ('HIGH', 'LOW')").groupBy("file").agg((F.min("start_line") + 100).alias("low"), (F.min("start_line") + 400).alias("high"))
    return hunk_reasons(rows, ("tools",), changed, hunks).select("id", "reason")


HANDOFFS = {"review": {"marks": ("severity", "symbol"), "required": ("title",), "allowed": {"severity": ("LOW", "MEDIUM", "HIGH")}}, "plain": {"marks": ("id",), "required": ("title", "note")}}


@book.query(C + """select id, case when symbol is not null and severity is not null then 'review' else 'plain' end as kind, list_filter([case when coalesce(title, '') = '' then 'missing title' end, case when symbol is null or severity is null then 'missing note' end,
  case when symbol is not null and severity = 'CRITICAL' then 'not allowed severity' end], lambda x: x is not null) as issues from f""")
def f16_handoffs(spark: SparkSession, folder: str) -> DataFrame:
    """What kind of record each finding makes, and what it lacks."""
    cells = [("id", F.col("id")), ("title", F.coalesce("title", F.lit(""))), ("severity", F.col("severity")), ("symbol", F.col("symbol"))]
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in cells]), lambda p: p["v"].isNotNull())
    return _clean(spark, folder).select("id", handoff(F.map_from_entries(pairs), HANDOFFS).alias("h")).select("id", "h.kind", "h.issues")


@book.query(C + """, e as (select id, unnest([case when introduced then {'kind': 'reflection', 'name': coalesce(symbol, 'none')} end, {'kind': 'container', 'name': 'Panel' || start_line}, case when severity = 'HIGH' then {'kind': 'listener', 'name': 'onEvent'} end, {'kind': 'import', 'name': 'lazy'}]) as e from f where start_line is not null and (symbol is null or regexp_matches(symbol, '^[A-Za-z_][A-Za-z0-9_]*$')))
select id, e.kind as kind, e.name as name from e where e is not null""")
def v12_dynamic_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Names of small texts, made from the findings, that are reachable without a call."""
    rows = _clean(spark, folder).where(F.col("start_line").isNotNull() & (F.col("symbol").isNull() | F.col("symbol").rlike("^[A-Za-z_][A-Za-z0-9_]*$")))
    code = F.concat(
        F.when(F.col("introduced"), F.concat(F.lit('Class.forName("app.x.'), F.coalesce("symbol", F.lit("none")), F.lit('");\n'))).otherwise(""), F.lit("@Service\npublic class Panel"), F.col("start_line").cast("string"),
        F.lit(" { }\n"), F.when(F.col("severity") == "HIGH", '@KafkaListener(topics = "t")\n void onEvent(String s) { }\n').otherwise(""), F.lit("const p = () => import('./views/lazy.vue')\n"),
    )
    return codefacts.dynamic_entries(rows.select("id", code.alias("code")), "id", "code")


@book.query(r"""with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as d, len(regexp_extract_all(coalesce(text, ''), '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')) as c from documents),
r as (select doc_id, list_filter([case when len(string_split(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(10))) > 400 then 'lines' end, case when len(regexp_extract_all(t, '[A-Za-z0-9_]+|[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')) > 1200 then 'words' end,
  case when ceil((length(t) - c) / 4) + ceil(c * 2 / 3) > 2000 then 'tokens' end, case when not regexp_matches(t, '(?m)^#{1,6}\s') then 'no heading' end, case when length(trim(d)) = 0 then 'no description' end,
  case when length(trim(d)) between 1 and 19 then 'short description' end, case when length(trim(d)) > 0 then 'no exclusions' end], lambda x: x is not null) as rules from d)
select doc_id, rules, case when list_has_any(rules, ['lines', 'words', 'tokens']) then 'SPLIT' when len(rules) > 0 then 'OPTIMIZE' else 'KEEP' end as verdict from r""")
def v15_guide_rules(spark: SparkSession, folder: str) -> DataFrame:
    """What an audit finds in every document as a guiding text described by its source."""
    rows = table(spark, folder, "documents").select("doc_id", codefacts.guide_rules(F.col("text"), F.col("source")).alias("rules"))
    return rows.withColumn("verdict", codefacts.guide_verdict(F.col("rules")))


#: Words that make a change sensitive, in order.
SENSITIVE = ("payment", "refund", "amount", "coupon", "order", "transaction", "auth", "permission", "lock")
_FIRST = lambda c: "coalesce(" + ", ".join(f"case when contains(lower({c}), '{w}') then '{w}' end" for w in SENSITIVE) + ")"


@book.query(C + f"select id, coalesce({_FIRST('file')}, {_FIRST('title')}) as keyword from f")
def t14_sensitive(spark: SparkSession, folder: str) -> DataFrame:
    """The first sensitive word in a finding's path, else in its title."""
    return _clean(spark, folder).select("id", F.coalesce(fx.first_keyword(F.col("file"), SENSITIVE), fx.first_keyword(F.col("title"), SENSITIVE)).alias("keyword"))


QUERIES, SQL = book.queries, book.sql
