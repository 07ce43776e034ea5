"""Queries of clusters, code windows, methods, diffs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import clusters, codeblocks, components
from tallyloom.operators.findings import clean
from tallyloom.plans.base import Book
from tallyloom.plans.findings import C
from tallyloom.sources import diffs, reports, sinks, table

book = Book()


def _code(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, code): the fenced code of each document."""
    parts = F.filter(F.split("text", "```"), lambda x, i: i % 2 == 1)
    bodies = F.transform(parts, lambda x: F.regexp_replace(x, r"^[a-z]*\r?\n", ""))
    return table(spark, folder, "documents").select("doc_id", F.array_join(bodies, "\n").alias("code")).where("code != ''")


def _family_sql() -> str:
    return "case category" + "".join(f" when '{k}' then '{v}'" for k, v in clusters.FAMILY_OF.items()) + " else coalesce(category, '') end"


#: Leaders one after the other: each row looks at the leaders so far, in their order.
LEADERS = C.replace("with f0", "with recursive f0", 1) + f""", k as (select id, coalesce(file, '') as file, {_family_sql()} as family, coalesce(start_line, 0) as line, coalesce(symbol, '') as symbol,
  row_number() over (partition by coalesce(file, ''), {_family_sql()} order by coalesce(rank, -1) desc, case when isnan(confidence) then -1 else coalesce(confidence, -1) end desc, id) as i from f),
walk as (
  select file, family, i, id, id as leader, [{{'id': id, 'line': line, 'symbol': symbol}}] as leaders from k where i = 1
  union all
  select k.file, k.family, k.i, k.id, coalesce(list_filter(w.leaders, lambda l: abs(l.line - k.line) <= 3 or (k.symbol <> '' and l.symbol = k.symbol))[1].id, k.id),
    case when len(list_filter(w.leaders, lambda l: abs(l.line - k.line) <= 3 or (k.symbol <> '' and l.symbol = k.symbol))) > 0 then w.leaders else list_append(w.leaders, {{'id': k.id, 'line': k.line, 'symbol': k.symbol}}) end
  from walk w join k on k.file = w.file and k.family = w.family and k.i = w.i + 1)
"""


@book.query(LEADERS + "select id, leader as leader_id from walk")
def c1_leader_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clustered(clean(table(spark, folder, "findings")))


@book.query(LEADERS + """, j as (select w.leader as leader_id, f.*, case when confidence between 0 and 1 then confidence end as usable, coalesce(list_filter(sources, lambda s: s is not null), []) as said from walk w join f using (id)),
g as (select leader_id, count(*) as members, max(usable) as best, bool_or(introduced) as introduced, bool_and(historical) as historical, max(rank) as rank, list_sort(list_distinct(flatten(list(coalesce(sources, []))))) as sources from j group by 1)
select leader_id, members, introduced, historical, rank, sources, round(case when len(list_filter(sources, lambda s: s not in ('reviewer', 'symbol-index'))) >= 2 then least(best + 0.05::double, 0.99::double) else best end, 6) as confidence from g""")
def a28_merged_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean(table(spark, folder, "findings"))
    return clusters.merged(rows, clusters.clustered(rows))


_TOKENS = r"""'"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''|[A-Za-z_]\w*|\d+(?:\.\d+)?|\S'"""
_KEPT = ", ".join(f"'{w}'" for w in sorted(codeblocks.KEYWORDS))
DUP = rf"""with c as (select doc_id, array_to_string(list_transform(list_filter(string_split(text, '```'), lambda x, i: i % 2 = 0), lambda x: regexp_replace(x, '^[a-z]*\r?\n', '')), chr(10)) as code from documents),
t as (select doc_id, list_transform(regexp_extract_all(code, {_TOKENS}), lambda t: case when (t[1] = '"' or t[1] = '''') and length(t) > 1 then 'STR' when regexp_matches(t, '^\d') then 'NUM' when regexp_matches(t, '^[A-Za-z_]') then case when t in ({_KEPT}) then t else 'ID' end else t end) as toks from c where code <> ''),
w as (select doc_id, i as start, array_to_string(list_slice(toks, i + 1, i + 20), ' ') as print from t, lateral (select unnest(range(0, len(toks) - 19)) as i) where len(toks) >= 20),
m as (select *, min({{'d': doc_id, 's': start}}) over (partition by print) as first, count(*) over (partition by print) as copies from w),
r as (select *, start - row_number() over (partition by doc_id order by start) as run from m where copies > 1 and (first.d <> doc_id or first.s <= start - 20)),
g as (select doc_id, min(start) as start, count(*) + 19 as tokens, min_by(first, start) as first from r group by doc_id, run)
"""


@book.query(DUP + "select doc_id as key, start, tokens, first.d as first_key, first.s as first_start from g where tokens >= 30")
def b41_duplicate_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of thirty tokens or more that stand before, here or in another text, at any offset."""
    blocks = codeblocks.duplicate_blocks(_code(spark, folder), "doc_id", "code", 20, 30)
    return blocks.select("key", F.col("start").cast("long").alias("start"), F.col("tokens").cast("long").alias("tokens"), "first_key", F.col("first_start").cast("long").alias("first_start"))


@book.query(r"""with c as (select doc_id, array_to_string(list_transform(list_filter(string_split(text, '```'), lambda x, i: i % 2 = 0), lambda x: regexp_replace(x, '^[a-z]*\r?\n', '')), chr(10)) as code from documents),
l as (select doc_id, unnest(string_split(code, chr(10))) as line, generate_subscripts(string_split(code, chr(10)), 1) as n from c where code <> '')
select doc_id as key, regexp_extract(line, '^\s*public int (\w+)\(int limit\) \{', 1) as method, n as start_line, 3 as lines, 1 as cyclomatic, 0 as nesting, 1 as parameters, []::varchar[] as rules from l where regexp_matches(line, '^\s*public int (\w+)\(int limit\) \{')""")
def b12_method_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return codeblocks.scan(_code(spark, folder), "doc_id", "code")


@book.query(r"""with w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9_@][A-Za-z0-9_.@/\-]*')) as rule_id from documents) select distinct rule_id from findings where rule_id not in (select rule_id from w)""")
def b10_unused_names(spark: SparkSession, folder: str) -> DataFrame:
    """Declared names, here rule ids, that no text holds."""
    names = table(spark, folder, "findings").select("rule_id").distinct()
    return codeblocks.unused_names(names, table(spark, folder, "documents"), "rule_id", "text")


def _diff_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A small diff for each finding, made from its own columns: the graver, the more lines are deleted before the first
    added one, and a kept line stands between the two."""
    path = F.col("file")
    gone = F.repeat(F.lit("-old\n"), F.coalesce("rank", F.lit(0)) + 1)
    body = [F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -"), F.col("start_line").cast("string"), F.lit(","), (F.coalesce("rank", F.lit(0)) + 3).cast("string"), F.lit(" +"), F.col("start_line").cast("string"), F.lit(",4 @@\n kept\n"), gone, F.lit("+new "), F.col("id"), F.lit("\n mid\n+more")]
    return clean(table(spark, folder, "findings")).select(F.concat(*body).alias("diff"))


@book.query(C + """select file as path, (start_line + k)::int as line_no, case when k = 1 then 'new ' || id else 'more' end as text from f, (values (1), (3)) v(k)""")
def s7_added_lines(spark: SparkSession, folder: str) -> DataFrame:
    return diffs.added_lines(diffs.read_diffs(_diff_texts(spark, folder), "diff"))


@book.query(C + """, l as (select case rank when 0 then 'A' when 1 then 'M' when 2 then 'R' when 3 then 'D' end as kind, file from f where file is not null and rank is not null)
select kind, count(*) as n, count(distinct file) as paths, (count(*) filter (kind = 'R'))::bigint as moved from l group by 1""")
def s6_name_status(spark: SparkSession, folder: str) -> DataFrame:
    """Name-status lines of all kinds; renamed files carry both names, and lines of no kind are left out."""
    path = F.col("file")
    line = F.when(F.col("rank") == 0, F.concat(F.lit("A\t"), path)).when(F.col("rank") == 1, F.concat(F.lit("M\t"), path)).when(F.col("rank") == 2, F.concat(F.lit("R090\told/"), path, F.lit("\t"), path)).otherwise(F.concat(F.lit("D\t"), path))
    rows = clean(table(spark, folder, "findings")).where("file is not null and rank is not null")
    lines = rows.select(F.explode(F.array(line, F.concat(F.lit("?? "), path))).alias("l"))
    moved = F.count_if(F.col("old_path") == F.concat(F.lit("old/"), F.col("path")))
    return diffs.name_status(lines, "l").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"), moved.alias("moved"))


@book.query(C + "select rule_id, title as message, file, start_line, end_line, case severity when 'HIGH' then 'HIGH' when 'MEDIUM' then 'MEDIUM' else 'LOW' end as severity, 'semgrep' as provider from f")
def s16_semgrep(spark: SparkSession, folder: str) -> DataFrame:
    rows = clean(table(spark, folder, "findings"))
    level = F.when(F.col("severity") == "HIGH", "ERROR").when(F.col("severity") == "MEDIUM", "WARNING").otherwise("INFO")
    one = F.struct(
        F.concat(F.lit("rules.java."), "rule_id").alias("check_id"), F.col("file").alias("path"), F.struct(F.col("start_line").alias("line")).alias("start"), F.struct(F.col("end_line").alias("line")).alias("end"), F.struct(F.col("title").alias("message"), level.alias("severity")).alias("extra")
    )
    return reports.semgrep(rows.select(F.to_json(F.struct(F.array(one).alias("results"))).alias("payload")), "payload")


@book.query(C + r"select 'javac-' || case when severity = 'HIGH' then 'error' else 'warning' end as rule_id, coalesce(title, '') as message, file, start_line, start_line as end_line, case when severity = 'HIGH' then 'HIGH' else 'LOW' end as severity, 'javac' as provider from f where ends_with(file, '.java')")
def s18_javac(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("severity") == "HIGH", "error").otherwise("warning")
    rows = clean(table(spark, folder, "findings"))
    lines = rows.select(F.concat("file", F.lit(":"), F.col("start_line").cast("string"), F.lit(": "), kind, F.lit(": "), F.coalesce("title", F.lit(""))).alias("l"))
    return reports.javac(lines, "l")


@book.query(C + """select id, '{"id":"' || id || '","rule_id":"' || rule_id || '","start_line":' || start_line || ',"end_line":' || coalesce(cast(end_line as varchar), 'null') || '}' as json from f""")
def s21_json_report(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.json_rows(clean(table(spark, folder, "findings")), ["id", "rule_id", "start_line", "end_line"], keep=["id"])


@book.query(C + "select rule_id, min(category) as name from f group by 1")
def s22_sarif_rules(spark: SparkSession, folder: str) -> DataFrame:
    return sinks.sarif_rules(clean(table(spark, folder, "findings")))


def _components(spark: SparkSession, folder: str) -> DataFrame:
    """A component for each finding; what it breaks follows from the finding's columns."""
    rows = clean(table(spark, folder, "findings")).where("rank is not null")
    tag = F.when(F.col("rank") >= 2, "<order-panel :a=\"1\"/>").otherwise("<div/>")
    dropped = F.when(F.col("rank") == 0, "").otherwise("report(e)")
    residue = F.when(F.col("introduced"), "console.log(a)").otherwise("")
    script = F.concat(
        F.lit("import OrderPanel from './p'\nexport default {\n components: { OrderPanel },\n computed: {\n  first() {\n   const a = 1\n   const b = 2\n   return a + b\n  },\n  second() {\n   const a = 1\n   const b = 2\n   return a + b\n  }\n },\n methods: {\n  load(a) { try { go(a) } catch (e) { "), dropped, F.lit(" } "), residue, F.lit(" }\n }\n}\n// TODO later\nexport function fetch"),
        F.regexp_replace("id", "[^0-9]", ""), F.lit("(a, b) { return api.fetch(a, b) }\n"),
    )
    return rows.select("id", "rank", F.concat(F.lit("<template>"), tag, F.lit("</template>\n<script>\n"), script, F.when(F.col("rank") == 3, F.concat(F.lit("import { fetch"), F.regexp_replace("id", "[^0-9]", ""), F.lit(" } from './q'\n"))).otherwise(""), F.lit("</script>\n")).alias("text"))


@book.query(C + """, r as (select unnest(['DUP-COMPUTED', 'TODO-MARKER', 'API-WRAPPER-PASSTHRU', case when rank < 2 then 'UNUSED-COMPONENT' end, case when rank = 0 then 'EMPTY-CATCH' end, case when introduced then 'DEBUG-RESIDUE' end]) as rule from f where rank is not null) select rule, count(*) as n from r where rule is not null group by 1""")
def v1_component_rules(spark: SparkSession, folder: str) -> DataFrame:
    return components.scan(_components(spark, folder), "id", "text").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@book.query(C + "select id, 'fetch' || regexp_replace(id, '[^0-9]', '', 'g') as name from f where rank < 3")
def v2_unused_exports(spark: SparkSession, folder: str) -> DataFrame:
    return components.unused_exports(_components(spark, folder), "id", "text")


def _classes(spark: SparkSession, folder: str) -> DataFrame:
    """A Java-like class for each finding."""
    rows = clean(table(spark, folder, "findings")).where("rank is not null")
    name = F.concat(F.lit("C"), F.regexp_replace("id", "[^0-9]", ""))
    kept = F.when(F.col("rank") >= 2, " volatile").otherwise("")
    used = F.when(F.col("introduced"), "used();").otherwise("")
    code = F.concat(
        F.lit("interface I"), name, F.lit(" { }\nclass "), name, F.when(F.col("rank") == 3, F.lit("")).otherwise(F.concat(F.lit(" implements I"), name)), F.lit(" {\n private static"), kept, F.lit(" Thing one;\n static "), F.when(F.col("rank") == 1, "Map<String, Thing> cache = make();").otherwise("final int n = 1;"),
        F.lit("\n public static Thing get() { if (one == null) { synchronized (X.class) { if (one == null) { one = new Thing(); } } } "), used, F.lit(" return one; }\n private void used() { n(); }\n}\n"),
    )
    return rows.select("id", code.alias("code"))


@book.query(C + """select id, rule, name from (select id, 'DOUBLE-CHECK-NO-VOLATILE' as rule, 'one' as name from f where rank < 2 union all select id, 'SHARED-MUTABLE', 'cache' from f where rank = 1)""")
def b28_class_rules(spark: SparkSession, folder: str) -> DataFrame:
    return codeblocks.scan_classes(_classes(spark, folder), "id", "code").select(F.col("key").alias("id"), "rule", "name")


@book.query(C + "select id as key, 'method' as kind, 'used' as name from f where rank is not null and not coalesce(introduced, false)")
def b1_unused_members(spark: SparkSession, folder: str) -> DataFrame:
    return codeblocks.unused_members(_classes(spark, folder), "id", "code")


@book.query(C + "select 'IC' || regexp_replace(id, '[^0-9]', '', 'g') as name, case when rank = 3 then 0 else 1 end::bigint as implementations from f where rank is not null")
def b7_single_implementations(spark: SparkSession, folder: str) -> DataFrame:
    return codeblocks.single_implementations(_classes(spark, folder), "id", "code")


QUERIES, SQL = book.queries, book.sql
