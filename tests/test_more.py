"""Edge cases of the newer core operators: nulls, empty tables, hot keys, long inputs, brute force."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import descriptions, paths, redaction
from tallyloom.functions import text as fx
from tallyloom.operators import codeblocks, codefacts, components, evaluation, figures, findings, routing, scores, selection
from tallyloom.operators.scale import join_hot, tasks_for
from tallyloom.sources import diffs, files, sinks


def one(spark, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema)


def test_join_hot_equals_a_plain_join(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(50)}", i) for i in range(3000)] + [(None, -1)]
    df = spark.createDataFrame(rows, "k string, i int")
    by_key = df.groupBy("k").agg(F.max("i").alias("m"), F.count(F.lit(1)).alias("n"))
    plain = sorted(tuple(r) for r in df.join(by_key.drop("n"), "k").collect())
    assert sorted(tuple(r) for r in join_hot(df, by_key, ["k"], "n").collect()) == plain
    # As if there were very many rows: every key with enough of them is hot.
    assert sorted(tuple(r) for r in join_hot(df, by_key, ["k"], "n", 200_000).collect()) == plain
    assert join_hot(df.limit(0), by_key, ["k"], "n").count() == 0
    assert tasks_for(df) >= 2


def test_interpolated_percentiles(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", None]), rnd.choice([None, rnd.random() * 1000 - 200, float(rnd.randrange(5))])) for _ in range(500)] + [("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["p50"], r["p95"]) for r in scores.interpolated_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert set(got) == {"a", None}
    for key in got:
        values = sorted(v for k, v in rows if k == key and v is not None)
        for p, x in zip((0.5, 0.95), got[key], strict=True):
            at = (len(values) - 1) * p
            low = int(at)
            assert x == pytest.approx(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low))
    assert scores.interpolated_percentiles(df.limit(0), [], "v", {"p": 0.5}).count() == 0


def test_islands_over_blocks(spark):
    rnd = random.Random(3)
    spans = sorted({("f", a := rnd.randrange(40_000), a + rnd.choice([5, 50, 9000])) for _ in range(60)})
    df = spark.createDataFrame(spans, "k string, low int, high int")
    expected = []
    for _, a, b in spans:
        if expected and a <= expected[-1][1] + 1:
            expected[-1][1] = max(expected[-1][1], b)
        else:
            expected.append([a, b])
    assert sorted([r["low"], r["high"]] for r in scores.islands(df, "k", "low", "high").collect()) == expected
    chained = []
    for _, a, b in spans:
        if chained and a <= chained[-1][2]:
            chained[-1][1] = max(chained[-1][1], b)
            chained[-1][2] = b
        else:
            chained.append([a, b, b])
    sized = df.withColumn("size", F.col("high") - F.col("low"))
    assert sorted([r["low"], r["high"]] for r in scores.chained_spans(sized, "k", "low", "size").collect()) == [c[:2] for c in chained]
    assert scores.islands(df.limit(0), "k", "low", "high").count() == 0 and scores.chained_spans(sized.limit(0), "k", "low", "size").count() == 0


def test_duplicate_blocks_at_any_offset(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("+-*/%<>=&|^!;,.") for _ in range(1))
    block = [word() for _ in range(70)]
    rows = [(1, " ".join([word() for _ in range(13)] + block)), (2, " ".join([word() for _ in range(6)] + block + ["x", "=", "1"])), (3, " ".join(block[:15])), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id int, code string")
    got = [(r["key"], r["first_key"], r["start"], r["first_start"], r["tokens"]) for r in codeblocks.duplicate_blocks(df, "id", "code", 20, 40).collect()]
    assert len(got) == 1 and got[0][:2] == (2, 1) and got[0][2] <= 6 and got[0][3] <= 13 and got[0][4] >= 70
    twice = spark.createDataFrame([(1, " ".join(block + block))], "id int, code string")
    assert [(r["start"], r["first_start"]) for r in codeblocks.duplicate_blocks(twice, "id", "code", 20, 40).collect()] == [(70, 0)]
    assert codeblocks.duplicate_blocks(df.limit(0), "id", "code").count() == 0


def test_methods_in_methods():
    code = "class A { public void a(int x) { if (x > 1) { Runnable r = new Runnable() { public void run() { for (;;) { while (y) { z(); } } } }; } } }"
    found = {m["name"]: m for m in codeblocks.methods(code)}
    assert found["run"]["nesting"] == 2 and found["a"]["nesting"] == 3 and found["run"]["cyclomatic"] == 3 and found["a"]["cyclomatic"] == 4
    deep = "".join(f"public void m{i}(int a) {{ if (a) {{\n" for i in range(3000)) + "}}" * 3000
    began = time.time()
    assert len(codeblocks.methods(deep)) == 3000 and codeblocks.method_rules(deep)
    assert time.time() - began < 5


def test_redaction(spark):
    code = "aB3" * 20
    assert one(spark, f"x {code}== y").select(redaction.masked_values(F.col("t"))).first()[0] == "x *** y"
    digest = "0123456789abcdef" * 4
    assert one(spark, digest).select(redaction.masked_values(F.col("t"))).first()[0] == digest
    df = one(spark, {"Auth_Token": "a", "result_tokens": "7", "note": "sk-abcdefgh12", "none": None}, "m map<string,string>")
    r = df.select(redaction.masked_fields(F.col("m")).alias("m"), redaction.masked_fields(F.col("m"), False).alias("open"), redaction.touched_keys(F.col("m")).alias("k")).first()
    assert r["m"] == {"Auth_Token": "***", "result_tokens": "7", "note": "***", "none": None} and r["open"]["Auth_Token"] == "a" and r["open"]["note"] == "***" and r["k"] == ["Auth_Token", "note"]
    assert df.limit(0).select(redaction.masked_fields(F.col("m"))).count() == 0


def test_descriptions(spark):
    text = "Draws flow-charts for reviews /draw, 画流程图. Not for code /ai-code alone, release plans; or 发布"
    r = one(spark, text).select(descriptions.derived_tags(F.col("t")).alias("tags"), descriptions.derived_triggers(F.col("t"), F.lit("trig: chart | 图 prio: 9\nx")).alias("on"), descriptions.derived_exclusions(F.col("t")).alias("off")).first()
    assert r["tags"] == ["draw", "draws", "flow-charts", "reviews"] and r["on"] == ["chart", "图", "/draw", "画流程图"] and r["off"] == ["/ai-code", "code /ai-code alone", "release plans", "发布"]
    n = one(spark, None).select(descriptions.derived_tags(F.col("t")), descriptions.keywords(F.col("t")), descriptions.derived_exclusions(F.col("t")), descriptions.negative_clause(F.col("t"))).first()
    assert list(n) == [[], [], [], ""]
    task = spark.createDataFrame([("freeze the requirement now", ["requirement freeze"]), ("freeze it", ["requirement freeze"]), ("发布计划", ["发布"]), ("x", None)], "t string, p array<string>")
    assert [r[0] for r in task.select(descriptions.excludes(F.col("t"), F.col("p"))).collect()] == [True, False, True, False]


ENTRY = "entry_id string, surface array<string>, include array<string>, exclude array<string>, category string, status string, score double, root_lines int, replacement string"


def test_full_routes(spark):
    entries = spark.createDataFrame([("a", ["cache", "slow"], ["cache layer"], [], "perf", "active", 80.0, 100, None), ("b", ["cache"], [], ["cache layer"], "perf", "active", None, None, None), ("c", ["cache", "slow"], [], None, "perf", "blocked", None, 0, None), ("d", ["cache"], [], [], "perf", "deprecated", None, 0, "a"), ("e", ["zzz"], [], [], "perf", "active", None, 0, None)], ENTRY)
    tasks = spark.createDataFrame([(1, "the cache layer is slow", ["the", "cache", "layer", "is", "slow"], "perf"), (2, "nothing", ["nothing"], None)], "task_id int, task string, tokens array<string>, kind string")
    scored = {(r["task_id"], r["entry_id"]): r for r in routing.scored_routes(tasks, entries).collect()}
    assert scored[1, "a"]["score"] == pytest.approx(0.45 + 0.25 + 0.15 + 0.08 + 0.05 * 0.75) and scored[1, "b"]["reason"] == "excluded_phrase" and scored[1, "c"]["reason"] == "blocked" and scored[1, "d"]["reason"] == "replaced"
    # e has the category alone, which is below the band of the best.
    assert [(r["task_id"], r["entry_id"], r["place"]) for r in routing.full_routes(tasks, entries).collect()] == [(1, "a", 1)]
    assert routing.full_routes(tasks.limit(0), entries).count() == 0 and routing.full_routes(tasks, entries.limit(0)).count() == 0


CHECK = "max_chars int, max_sentences int, min_chars int, must_regex array<string>, require_fields array<string>, must_numbers boolean"


def test_text_scores(spark):
    rows = [(1, "A decision: use 5 workers.\nA risk: none.", (20, 2, 10, ["workers"], ["decision", "risk", "evidence"], True), True), (2, None, None, None), (3, "a\n\n\n\nb  \n---", (None, None, 100, [], [], False), False)]
    df = spark.createDataFrame(rows, f"id int, text string, check struct<{CHECK.replace(' ', ':').replace(',:', ',')}>, sticky boolean")
    got = {r["id"]: r for r in evaluation.scored(df, ["(?i)workers!"]).collect()}
    assert got[1]["brevity"] == pytest.approx(100 * 20 / 40, abs=1e-3) and got[1]["preserve"] == pytest.approx(200 / 3, abs=1e-3) and got[1]["accuracy"] == got[1]["adapt"] == got[1]["stick"] == 100
    assert got[2]["total"] == 100 and got[3]["discipline"] == 40 and got[3]["fidelity"] == pytest.approx(100 * 12 / 60, abs=1e-3)
    assert evaluation.score_summary(evaluation.scored(df.limit(0), []), ["sticky"]).count() == 0


def test_judges_and_order(spark):
    good = json.dumps({"case_id": "x", "label": "A", "correctness": 5, "actionability": 4, "concision": 3, "autonomy": 2, "safety": 1, "blocker": True})
    lines = spark.createDataFrame([(good,), ("[1]",), ("{broken",), ("  ",), (None,)], "l string")
    read = evaluation.read_judges(lines, "l")
    assert sorted(r["bad"] for r in read.collect()) == [False, True, True]
    key = spark.createDataFrame([("x", "A", "C1")], "case_id string, label string, cond string")
    r = evaluation.judge_summary(read, key).first()
    assert (r["cond"], r["n"], r["blockers"]) == ("C1", 1, 1) and r["weighted"] == pytest.approx(1.5 + 0.8 + 0.75 + 0.3 + 0.1)
    labels = spark.createDataFrame([(c, x) for c in ("p", "q") for x in "ABC"], "c string, label string")
    first, again = ({(r["c"], r["label"]): r["place"] for r in evaluation.seeded_order(labels, ["c"], "label", "r1").collect()} for _ in range(2))
    assert first == again and sorted(first[k] for k in first if k[0] == "p") == [1, 2, 3]


def test_windows_of_text(spark):
    lines = [f"l{i}" for i in range(1, 21)]
    df = spark.createDataFrame([(lines, [(3, 3), (12, 13)])], "l array<string>, r array<struct<low:int,high:int>>")
    assert df.select(fx.windowed(F.col("l"), F.col("r"), 1)).first()[0] == ["... [1 lines elided] ...", "l2", "l3", "l4", "... [6 lines elided] ...", "l11", "l12", "l13", "l14", "... [6 lines elided] ..."]
    assert df.select(fx.cut_to_bytes(F.col("l"), 7)).first()[0] == ["l1", "l2", "... [truncated at 7 bytes] ..."]
    assert df.select(fx.cut_to_bytes(F.col("l"), 1000)).first()[0] == lines
    assert one(spark, "日本\nx").select(fx.cut_to_bytes(fx.lines(F.col("t")), 7)).first()[0] == ["日本", "... [truncated at 7 bytes] ..."]
    head = one(spark, "---\na: 1\nb: 'x: y'\n- no\na: 2\n---\nbody\n---\n").select(fx.front_matter(F.col("t")).alias("f")).select(fx.front_fields(F.col("f.head")).alias("m"), "f.body").first()
    assert head["m"] == {"a": "2", "b": "x: y"} and head["body"] == "body\n---\n"
    assert one(spark, "no head").select(fx.front_matter(F.col("t")).alias("f")).first()["f"]["head"] is None


def test_selection(spark):
    rows = spark.createDataFrame([("HIGH", "tests", i) for i in range(9)] + [("LOW", "tests", 1), ("HIGH", "other", 1), (None, "tests", 1)], "level string, kind string, i int")
    assert sorted(r["i"] for r in selection.within_caps(rows, "level", "kind", ["i"]).collect()) == [0, 1, 2, 3]
    lines = spark.createDataFrame([(1, i, "hit" if i in (2, 30) else "x") for i in range(1, 41)], "k int, n long, t string")
    got = {(r["hit"], r["n"]) for r in selection.near_hits(lines, "k", "n", "t", "hit", 2, 5).collect()}
    assert got == {(2, 1), (2, 2), (2, 3), (2, 4), (30, 28), (30, 29), (30, 30), (30, 31), (30, 32)}
    many = lines.withColumn("t", F.lit("hit"))
    assert {r["hit"] for r in selection.near_hits(many, "k", "n", "t", "hit", 1, 5).collect()} == {1, 2, 3, 4, 5}
    names = spark.createDataFrame([(["b", "a"], ["a", "c"])], "x array<string>, y array<string>")
    assert names.select(selection.union_in_order(F.col("x"), F.col("y"))).first()[0] == ["b", "a", "c"]


def test_paths_and_code_facts(spark):
    kinds = {"src/test/A.java": "test", "a/FooTest.java": "test", "pom.xml": "config", "docs/x.java": "rule", "notes.txt": "document", "src/A.java": "source"}
    df = spark.createDataFrame([(p,) for p in kinds], "p string")
    assert {r["p"]: r["k"] for r in df.select("p", paths.path_kind(F.col("p")).alias("k")).collect()} == kinds
    assert one(spark, "src/Order_LineServiceImpl.java").select(paths.module_name(F.col("t"))).first()[0] == "orderlineservice"
    code = spark.createDataFrame([(1, 'class A { public int go(int x) { return run("a", "b"); } }\ndef run(x):\n  pass'), (2, None)], "id int, c string")
    assert sorted((r["kind"], r["name"]) for r in codefacts.symbols(code, "id", "c").collect()) == [("class", "A"), ("method", "go"), ("method", "run")]
    assert code.select(codefacts.literals(F.col("c"))).first()[0] == ["a", "b"]
    sql = spark.createDataFrame([(1, "UPDATE t set a = 1"), (2, "update t set a=1 WHERE b"), (3, "delete from t"), (4, "delete from ${t}"), (5, None)], "id int, s string")
    assert sorted((r["id"], r["rule"]) for r in codefacts.open_statements(sql, "id", "s").collect()) == [(1, "UPDATE-NO-WHERE"), (3, "DELETE-NO-WHERE")]


COMPONENT = """<template><order-panel/><Used/></template>
<script>
export default {
  components: { OrderPanel, Used, Spare },
  methods: {
    load(a) { try { go() } catch (e) { %s } },
  },
}
</script>"""


def test_components(spark):
    rules = lambda t: {(r, n) for r, _, n, _ in components.component_rules(t)}
    assert rules(COMPONENT % "") == {("UNUSED-COMPONENT", "Spare"), ("EMPTY-CATCH", "")}
    assert rules(COMPONENT % "report(e)") == {("UNUSED-COMPONENT", "Spare")}
    assert rules("function f(a, b) { return api.f(a, b) }") == {("API-WRAPPER-PASSTHRU", "f")} and not rules("function f(a, b) { return api.f(b, a) }")
    assert ("HUGE-COMPONENT", "") in rules("\n" * 900) and not rules("") and not rules("// console.log(1)")
    df = spark.createDataFrame([(1, "export const a = 1\nexport function b() {}"), (2, "import { a as c } from './1'"), (3, None)], "id int, t string")
    assert [tuple(r) for r in components.unused_exports(df, "id", "t").collect()] == [(1, "b")]
    began = time.time()
    components.component_rules("function f() {" * 5000 + "}" * 5000)
    assert time.time() - began < 5


def test_files(spark, tmp_path):
    (tmp_path / "a" / "skip").mkdir(parents=True)
    (tmp_path / "a" / "x.txt").write_bytes(b"text \xff end")
    (tmp_path / "a" / "b.txt").write_bytes(bytes(range(256)) * 4)
    (tmp_path / "a" / "big.txt").write_bytes(b"x" * 5000)
    (tmp_path / "a" / "empty.txt").write_bytes(b"")
    (tmp_path / "a" / "skip" / "y.txt").write_text("y")
    found = files.walk(spark, str(tmp_path), (".txt",), ("skip",), 4000)
    assert sorted(r["name"] for r in found.select("name").collect()) == ["b.txt", "x.txt"]
    assert {r["name"]: r["text"] for r in files.texts(found).collect()} == {"x.txt": "text � end"}
    ledgers = tmp_path / "l"
    ledgers.mkdir()
    (ledgers / "1.json").write_text('{\n "run_id": "r1",\n "duration_ms": 5\n}')
    (ledgers / "2.json").write_text('{"repo": "x"}')
    (ledgers / "3.json").write_text("{broken")
    got = {r["file"]: (r["run_id"], r["skipped"]) for r in files.read_ledgers(spark, str(ledgers)).collect()}
    assert got == {"1.json": ("r1", False), "2.json": (None, True), "3.json": (None, True)}


def test_yaml():
    text = "a: 1\nb:\n  c: 'x # y'\n  d: [1, \"p, q\"]\nlist:\n- one\n- k: v\n  m: true\nempty:\n# note\nlast: 2.5\n"
    assert files.parse_yaml(text) == [("a", "1"), ("b.c", "x # y"), ("b.d.0", "1"), ("b.d.1", "p, q"), ("list.0", "one"), ("list.1.k", "v"), ("list.1.m", "true"), ("last", "2.5")]
    assert files.parse_yaml("") == [] and files.parse_yaml("just words") == []


def test_sinks_and_reasons(spark):
    df = spark.createDataFrame([("1", "a|b\nc", None), ("2", None, "k")], "id string, title string, api_key string")
    assert [r["line"] for r in sinks.markdown_rows(df, ["id", "title"], ["id"]).orderBy("part", "id").collect()] == ["| id | title |", "|---|---|", "| 1 | a\\|b c |", "| 2 |  |"]
    rows = sinks.checked_lines(df, ["title"], ["id", "api_key"], ["id"]).orderBy("id").collect()
    assert json.loads(rows[0]["json"]) == {"id": "1", "api_key": "***"} and rows[1]["json"] is None and rows[1]["missing"] == ["title"]
    found = spark.createDataFrame([("a", "x/f", 5), ("b", "x/f", 50), ("c", "y", 1), ("d", "g", 9), ("e", "gone", 1), ("f", None, 1)], "id string, file string, start_line int")
    changed = spark.createDataFrame([("x/f",), ("g",), ("y",)], "file string")
    hunks = spark.createDataFrame([("x/f", 1, 10)], "file string, low int, high int")
    assert {r["id"]: r["reason"] for r in findings.hunk_reasons(found, ["y"], changed, hunks).collect()} == {"a": None, "b": "outside_hunk", "c": "excluded_path", "d": None, "e": "outside_change", "f": "outside_change"}


def test_figures(spark):
    boxes = spark.createDataFrame([("f", 0.0, 0.0, 10.0, 10.0), ("f", 20.0, 0.0, 10.0, 10.0), ("f", 40.0, 0.0, 10.0, 10.0), ("f", 200.0, 0.0, 10.0, 10.0), ("g", 0.0, 0.0, 300.0, 100.0)], "k string, x double, y double, w double, h double")
    got = {r["k"]: r for r in figures.violations(figures.measured(boxes, "k")).collect()}
    assert got["f"]["islands"] == 1 and got["f"]["coverage"] == pytest.approx(400 / 2100, abs=1e-6) and got["f"]["codes"] == ["narrow", "ratio", "islands"] and got["g"]["codes"] == []
    assert figures.measured(boxes.limit(0), "k").count() == 0


def test_diff_numbers(spark):
    text = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -5,4 +5,3 @@\n a\n-b\n-c\n+d\n e\n"
    df = one(spark, text)
    assert [tuple(r) for r in diffs.added_lines(diffs.read_diffs(df, "t")).collect()] == [("f", 6, "d")]
