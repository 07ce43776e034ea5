"""Small fixtures for operators that SQL does not check."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.schema import broken_rules
from tallyloom.functions.text import cjk_bigrams, token_estimate, token_estimate_wide
from tallyloom.operators import clusters, codeblocks, diagrams, findings, joins, scores
from tallyloom.sources import diffs, reports, sinks


def brute_leaders(rows):
    """Every row against every leader."""
    leaders, out = [], []
    for id_, line, symbol in rows:
        for lid, lline, lsymbol in leaders:
            if symbol and symbol == lsymbol or abs(line - lline) <= clusters.NEAR:
                out.append(lid)
                break
        else:
            leaders.append((id_, line, symbol))
            out.append(id_)
    return out


def test_leader_fold_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        rows = [(str(i), rnd.randrange(30), rnd.choice(["", "", "f", "g"])) for i in range(rnd.randrange(14))]
        fold = clusters.Fold()
        assert [fold.leader(*r) for r in rows] == brute_leaders(rows)


def test_leader_clusters(spark):
    rows = [("a", "f", "DEAD_CODE", 1, 10, None), ("b", "f", "DEAD_CODE", 0, 13, None), ("c", "f", "DEAD_CODE", 0, 16, None), ("d", "f", "DEAD_CODE", 0, 14, None), ("e", "g", "DEAD_CODE", 0, 10, None), ("h", "f", "PERFORMANCE", 0, 10, None), ("i", "f", "COMPLEXITY", 0, 90, "s"), ("j", "f", "LARGE_METHOD", 1, 10, "s"), (None, None, None, None, None, None)]
    df = spark.createDataFrame([(*r[:4], None, *r[4:]) for r in rows], "id string, file string, category string, rank int, confidence double, start_line int, symbol string").where("id is not null")
    got = {r["id"]: r["leader_id"] for r in clusters.clustered(df).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "h": "h", "i": "j", "j": "j"}


def test_methods_and_rules():
    code = '''class A {
  // public void no() {
  public int one(int a, int b, int c, int d, int e, int f) {
    String s = "if (x) {";
    for (int i = 0; i < 3; i++) { if (a > b && c > d) { repo.findById(i); } }
    try { x(); } catch (Exception e2) { }
    return a > 0 ? 1 : 2;
  }
  private static String two() throws IOException { try { return y(); } catch (IOException e) { return null; } }
}'''
    found = {m["name"]: m for m in codeblocks.methods(code)}
    assert set(found) == {"one", "two"}
    assert (found["one"]["parameters"], found["one"]["cyclomatic"], found["one"]["nesting"]) == (6, 6, 2)
    hits = {(r, m) for r, _, m, _ in codeblocks.method_rules(code)}
    assert {("LONG-PARAM-LIST", "one"), ("EMPTY-CATCH", "one"), ("GENERIC-CATCH", "one"), ("CATCH-RETURN-NULL", "two")} <= hits
    assert ("EMPTY-CATCH", "two") not in hits
    assert codeblocks.methods("") == []


RULE_CASES = [
    ("RETRY-AMPLIFY", "for (int i = 0; i < n; i++) { client.retry(x); }", "for (int i = 0; i < n; i++) { retry(x); sleep(backoff); }"),
    ("SWALLOW-AND-SUCCESS", "try { a(); } catch (IOException e) { return true; }", "try { a(); return true; } catch (IOException e) { throw e; }"),
    ("UNCLOSED-RESOURCE", "FileReader r = new FileReader(f); r.read();", "try (FileReader r = new FileReader(f)) { r.read(); }"),
    ("EXECUTOR-PER-CALL", "Executors.newFixedThreadPool(2).submit(x);", "var p = Executors.newFixedThreadPool(2); p.submit(x); p.shutdown();"),
    ("SEMAPHORE-LEAK", "s.acquire(); work(); s.release();", "s.acquire(); try { work(); } finally { s.release(); }"),
    ("LOCK-REMOTE-CALL", "lock.lock(); userClient.fetch(a);", "userClient.fetch(a); "),
    ("NPLUS1", "for (A a : as) { repo.findById(a); }", "repo.findAll(as);"),
    ("REPEAT-SERIALIZE", "for (A a : as) { out(toJson(a)); }", "out(toJson(as));"),
    ("ON2", "for (A a : as) { for (B b : bs) { if (b.equals(a)) { n++; } } }", "for (A a : as) { if (set.contains(a)) { n++; } }"),
    ("UNBOUNDED-IN", "repo.findAllById(userIds);", "for (var part : partition(userIds)) { repo.findAllById(part); }"),
]


@pytest.mark.parametrize(("rule", "bad", "good"), RULE_CASES)
def test_body_rules(rule, bad, good):
    hits = lambda body: {r for r, *_ in codeblocks.method_rules("class A { public void m(int a) { %s } }" % body)}
    assert rule in hits(bad) and rule not in hits(good)
    assert rule not in hits(f'String s = "{bad.replace(chr(34), "")}";')


def test_class_rules_and_corpus_rules(spark):
    lazy = "class L { private static L one; static L get() { if (one == null) { synchronized (L.class) { if (one == null) { one = new L(); } } } return one; } }"
    assert {r for r, *_ in codeblocks.class_rules(lazy)} == {"DOUBLE-CHECK-NO-VOLATILE"}
    assert codeblocks.class_rules(lazy.replace("private static", "private static volatile")) == []
    assert [r for r, *_ in codeblocks.class_rules("class S { static Map<String, A> cache = new HashMap<>(); static final List<A> X = List.of(); }")] == ["SHARED-MUTABLE"]
    files = [(1, "interface P { } interface Q { } class A implements P, Q { private int used; private int spare; private void gone() { } private void kept() { used = 1; kept(); } }"), (2, "class B implements P { }"), (3, None)]
    df = spark.createDataFrame(files, "id int, code string")
    assert sorted(r["name"] for r in codeblocks.unused_members(df, "id", "code").collect()) == ["gone", "spare"]
    assert [tuple(r) for r in codeblocks.single_implementations(df, "id", "code").collect()] == [("Q", 1)]
    names = spark.createDataFrame([("app.limit",), ("app.gone",)], "name string")
    texts = spark.createDataFrame([("get(app.limit)",), (None,)], "t string")
    assert [r["name"] for r in codeblocks.unused_names(names, texts, "name", "t").collect()] == ["app.gone"]


CLASS_CASES = [
    ("THREADPOOL-NO-SHUTDOWN", "class A { private final ExecutorService pool = Executors.newFixedThreadPool(2); }", "class A { private final ExecutorService pool = Executors.newFixedThreadPool(2); void end() { pool.shutdown(); } }"),
    ("GLOBAL-MUTABLE-SINGLETON", "class A { private static A instance = new A(); static void set(A a) { instance = a; } }", "class A { private static A instance = new A(); static A get() { return instance; } }"),
    ("TX-REMOTE-CALL", "class A { @Transactional public void pay(int a) { repo.save(a); httpClient.send(a); } }", "class A { @Transactional public void pay(int a) { repo.save(a); } void b() { httpClient.send(1); } }"),
    ("COMMENTED-CODE", "\n".join(f"// int x{i} = call({i});" for i in range(5)), "\n".join(f"// a remark of words {i}" for i in range(6))),
]


@pytest.mark.parametrize(("rule", "bad", "good"), CLASS_CASES)
def test_class_rules_fire_and_rest(rule, bad, good):
    assert rule in {r for r, *_ in codeblocks.class_rules(bad)} and rule not in {r for r, *_ in codeblocks.class_rules(good)}
    assert rule not in {r for r, *_ in codeblocks.class_rules("")}


def test_token_windows(spark):
    a = "x = 1 + y; " * 12
    b = "zz = 77 + q; " * 12
    df = spark.createDataFrame([(1, a), (2, b), (3, "other(1)"), (4, None)], "id int, code string")
    shared = codeblocks.shared_windows(codeblocks.windows(df, "id", "code")).collect()
    assert shared and all(r["files"] == 2 for r in shared)


DIFF = """diff --git a/src/A.java b/src/A.java
--- a/src/A.java
+++ b/src/A.java
@@ -1,2 +1,3 @@
 keep
-old
+new
+--- looks like a header
@@ -10 +11 @@
-x
+y
\\ No newline at end of file
diff --git a/o.py b/p.py
rename from o.py
rename to p.py
diff --git a/z b/z
new file mode 100644
--- /dev/null
+++ b/z
@@ -0,0 +1 @@
+only
"""


def test_diff(spark):
    rows = diffs.parse_diff(DIFF)
    assert [(r[0], r[2], r[3]) for r in rows] == [("src/A.java", "M", 1), ("src/A.java", "M", 2), ("p.py", "R", 0), ("z", "A", 1)]
    df = spark.createDataFrame([(DIFF,), (None,), ("",)], "t string")
    got = sorted(tuple(r) for r in diffs.added_lines(diffs.read_diffs(df, "t")).collect())
    assert got == [("src/A.java", 2, "new"), ("src/A.java", 3, "--- looks like a header"), ("src/A.java", 11, "y"), ("z", 1, "only")]


def test_name_status(spark):
    df = spark.createDataFrame([("M\ta",), ("R100\told\tnew",), ("nonsense",)], "l string")
    assert sorted(tuple(r) for r in diffs.name_status(df, "l").collect()) == [("M", "a", None), ("R", "new", "old")]


def test_xml_and_json_reports(spark):
    one = lambda text: spark.createDataFrame([(text,)], "p string")
    pmd = '<pmd><file name="A.java"><violation beginline="3" endline="4" rule="R" priority="1"> m </violation></file></pmd>'
    assert [tuple(r) for r in reports.pmd(one(pmd), "p").collect()] == [("pmd", "R", "m", "A.java", 3, 4, "HIGH")]
    cpd = '<pmd-cpd><duplication lines="5" tokens="300"><file line="1" path="a"/><file line="9" path="b"/></duplication></pmd-cpd>'
    assert sorted(tuple(r)[3:] for r in reports.cpd(one(cpd), "p").collect()) == [("a", 1, 5, "HIGH"), ("b", 9, 13, "HIGH")]
    bugs = '<BugCollection><BugInstance type="NP" priority="2"><LongMessage>null</LongMessage><SourceLine sourcepath="B.java" start="7" end="8"/></BugInstance></BugCollection>'
    assert [tuple(r)[1:] for r in reports.spotbugs(one(bugs), "p").collect()] == [("NP", "null", "B.java", 7, 8, "MEDIUM")]
    knip = '{"files":["dead.ts"],"issues":[{"file":"a.ts","exports":[{"name":"f","line":3}],"types":[]}]}'
    assert sorted(r["rule_id"] for r in reports.knip(one(knip), "p").collect()) == ["unused-exports", "unused-files"]


def test_globs():
    cases = {("src/**/*.java", "src/A.java"): True, ("src/**/*.java", "src/a/b/C.java"): True, ("src/*.java", "src/a/C.java"): False, ("a?.py", "ab.py"): True, ("**/x", "q/w/x"): True}
    for (pattern, path), expected in cases.items():
        assert bool(re.match(findings.glob_to_regex(pattern), path)) is expected, (pattern, path)


def test_schema_rules(spark):
    schema = {"required": ["a"], "properties": {"a": {"minimum": 1, "maximum": 3}, "b": {"pattern": "^x", "minLength": 2}, "c": {"items": {"minimum": 0}, "maxItems": 2}, "a2": {"anyOf": [{"const": 1}, {"const": 2}]}, "a3": {"oneOf": [{"minimum": 0}, {"maximum": 5}]}}}
    rows = [(None, "x", [1, -1, 2], 3, 9), (4, "xy", [1], 2, 2), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "a int, b string, c array<int>, a2 int, a3 int")
    got = [r[0] for r in df.select(broken_rules(schema)).collect()]
    assert got == [["a: required", "b: minLength", "c: maxItems", "c: items", "a2: anyOf"], ["a: maximum", "a3: oneOf"], []]


def test_diagrams(spark):
    dsl = "flowchart LR\n a[Alpha] --> b\n b -->|yes| c(Gamma)\n c ~~~ a\n lone\n"
    nodes, edges = diagrams.parse_flow(dsl)
    assert nodes == [("a", "Alpha"), ("b", "b"), ("c", "Gamma"), ("lone", "lone")] and edges[2] == ("c", "a", True)
    flows = diagrams.read_flows(spark.createDataFrame([(1, dsl), (2, None)], "k int, d string"), "k", "d")
    assert [(r["key"], r["id"]) for r in diagrams.isolated(flows).collect()] == [(1, "lone")]
    assert [tuple(r)[:2] for r in diagrams.lint(spark.createDataFrame([(1, dsl), (2, None)], "k int, d string"), "k", "d").collect()] == [(1, "P08")]
    assert diagrams.longest_path(["a", "b", "c", "d"], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")]) == 3
    assert diagrams.longest_path([], []) == 0


LINT = [
    ("P01", "flowchart\n a --> b", "flowchart TD\n a --> b"), ("P02", "flowchart LR\n" + "\n".join(f" a --> b{i}" for i in range(12)), "flowchart LR\n a --> b"), ("P03", "flowchart LR\n" + "\n".join(f" a{i % 4} --> b{i % 5}" for i in range(15)), "flowchart LR\n a --> b"),
    ("P04", "flowchart LR\n a[twenty-seven signs in a label] --> b", "flowchart LR\n a[twenty-six signs <br/> in two lines] --> b"), ("P05", "flowchart LR\n a[<u>x</u>] --> b", "flowchart LR\n a[x<br/>y] --> b"), ("P06", "flowchart LR\n a[pay (new)] --> b", 'flowchart LR\n a["pay (new)"] --> b'),
    ("P07", "flowchart LR\n subgraph s\n a\n end\n a --> b", "flowchart LR\n subgraph s\n a --> b\n end"), ("P08", "flowchart LR\n a --> b\n c", "flowchart LR\n a --> b\n c ~~~ a"), ("P09", "flowchart LR\n" + "\n".join(f" a{i} --> a{i + 1}" for i in range(7)), "flowchart LR\n" + "\n".join(f" a{i} --> a{i + 1}" for i in range(6))),
    ("P10", "flowchart TD\n" + "\n".join(f" a{i} --> a{i + 1}" for i in range(7)), "flowchart TD\n a0 --> z\n" + "\n".join(f" a{i} --> a{i + 1}" for i in range(7))), ("P11", "flowchart LR\n a[OrderService.java] --> b", "flowchart LR\n a[order service] --> b"), ("P12", "flowchart LR\n a[orderService] --> b", "flowchart LR\n a[orders] --> b"),
    ("P13", "flowchart LR\n 支付 --> b", "flowchart LR\n pay[支付] --> b"), ("P14", "flowchart LR\n end --> b", "flowchart LR\n End --> b"),
]


@pytest.mark.parametrize(("rule", "bad", "good"), LINT)
def test_every_lint_rule_fires(rule, bad, good):
    assert rule in {r for r, _ in diagrams.lint_figure(bad)} and rule not in {r for r, _ in diagrams.lint_figure(good)}


def test_islands_and_intervals(spark):
    df = spark.createDataFrame([("f", 1, 9), ("f", 3, 4), ("f", 10, 12), ("f", 20, 21)], "k string, low int, high int")
    assert sorted((r["low"], r["high"]) for r in scores.islands(df, "k", "low", "high").collect()) == [(1, 12), (20, 21)]
    rnd = random.Random(2)
    spans = [("f", a := rnd.randrange(500), a + rnd.randrange(200)) for _ in range(12)]
    points = [("f", i, i) for i in range(0, 800, 7)] + [(None, 1, 1)]
    hit = joins.in_intervals(spark.createDataFrame(points, "k string, id int, p int"), spark.createDataFrame(spans, "k string, low int, high int"), "k", "p")
    assert sorted(r["id"] for r in hit.collect()) == [i for k, i, p in points if k and any(a <= p <= b for _, a, b in spans)]


def test_text_edges(spark):
    df = spark.createDataFrame([("漢",), ("漢字仮",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(cjk_bigrams(F.col("t"))).collect()] == [["漢"], ["漢字", "字仮"], [], None]
    assert [tuple(r) for r in df.select(token_estimate(F.col("t")), token_estimate_wide(F.col("t"))).collect()][:3] == [(1, 1), (2, 3), (0, 0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("R", "C", "HIGH", "t", "f", 3, None)], "rule_id string, category string, severity string, title string, file string, start_line int, end_line int")
    assert '"level":"error"' in sinks.sarif_results(df).first()["json"]
    sinks.write_snapshot(df, str(tmp_path / "s"), 1)
    sinks.write_snapshot(df, str(tmp_path / "s"), 2)
    assert sorted(r["seq"] for r in spark.read.json(str(tmp_path / "s")).collect()) == [1, 2]
    sinks.append_lines(df, str(tmp_path / "l"))
    sinks.append_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2


def test_baseline_compare_null_keys(spark):
    a = spark.createDataFrame([("r", None), ("s", "x")], "rule string, symbol string")
    b = spark.createDataFrame([("r", None), ("t", "x")], "rule string, symbol string")
    got = {(r["rule"], r["change"]) for r in joins.compare(a, b, ["rule", "symbol"]).collect()}
    assert got == {("r", "kept"), ("s", "closed"), ("t", "appeared")}
