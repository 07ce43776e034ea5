from datetime import datetime

from tallyloom.llm.survivors import BY_TRUTH, components, present_ids, source_quality, survivors, true_values

FINDING = "id string, title string, severity string, confidence double, start_line int, end_line int, symbol string, perf_confidence string, sources array<string>, reported_at timestamp, received_at timestamp, value string"
GROUP = "kept_id string, merged_ids array<string>, reason string"
D1, D2 = datetime(2025, 1, 1), datetime(2025, 2, 1)


def finding(id, sources=("pmd",), at=D1, **over):
    row = {"id": id, "title": "t " + (id or ""), "severity": "low", "confidence": 0.5, "start_line": 3, "end_line": 5, "symbol": "f", "perf_confidence": None, "sources": list(sources) if sources is not None else None, "reported_at": at, "received_at": at, "value": "clash"} | over
    return tuple(row[c.split()[0]] for c in FINDING.split(", "))


def run(spark, findings, groups, **more):
    f = spark.createDataFrame(findings, FINDING)
    g = spark.createDataFrame([(*x, "why") for x in groups], GROUP)
    p = spark.createDataFrame([("javac", 1), ("pmd", 3), ("reviewer", 9)], "provider string, trust_rank int")
    return {(r["group_key"], r["field_name"]): r["finding_id"] for r in survivors(f, g, p, **more).collect()}


def test_trust_then_date_then_id(spark):
    found = [finding("a", ["reviewer"], D2), finding("b", [" PMD:2.1 "]), finding("c", ["pmd"], D2), finding("d", ["pmd"], D2), finding("e", ["nobody"], D2)]
    got = run(spark, found, [("e", ["d", "c"]), ("c", ["a", "b"])])
    assert got == {("a", f): "c" for f in ("title", "severity", "confidence", "end_line", "symbol")}


def test_unusable_values_leave_the_field_to_the_next(spark):
    bad = finding("a", ["javac"], title=" N/A ", severity="5", confidence=float("nan"), end_line=2, symbol="<none>", perf_confidence="tbd")
    good = finding("b", None, perf_confidence="proven", confidence=1.0)
    got = run(spark, [bad, good], [("a", ["b", "b", None, "missing"])])
    assert set(got.values()) == {"b"} and ("a", "perf_confidence") in got
    assert run(spark, [bad], [("a", None)]) == {}


def test_last_delivery_of_a_report(spark):
    got = run(spark, [finding("a", title="old"), finding("a", title=None, received_at=D2)], [("a", ["a"])])
    assert ("a", "title") not in got and ("a", "symbol") in got


def test_groups_through_missing_ids_do_not_join(spark):
    got = run(spark, [finding("a"), finding("b")], [("a", ["zz"]), ("b", ["zz"]), ("q", ["zz"])])
    assert {k for k, _ in got} == {"a", "b"}


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [finding("a")], []) == {}


def test_components_of_chains_and_hubs(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("h", f"z{i}") for i in range(80)] + [("solo", "solo")]
    got = {r["id"]: r["group_key"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and {got[f"z{i}"] for i in range(80)} == {"h"} and got["solo"] == "solo"


def test_quality_model_learns_who_errs_and_keeps_several_true_values(spark):
    found, groups = [], []
    for g in range(60):
        ids = [f"g{g:02}{s}" for s in "abc"]
        # javac and pmd agree on the truth, reviewer names something else in two groups of three.
        titles = ["right", "right", "wrong" if g % 3 else "right"]
        for i, s, t in zip(ids, ("javac", "pmd", "reviewer"), titles, strict=True):
            found.append(finding(i, [s], title=f"{t} {g}"))
        groups.append((ids[0], ids[1:]))
    f, g = spark.createDataFrame(found, FINDING), spark.createDataFrame([(*x, "why") for x in groups], GROUP)
    p = spark.createDataFrame([("javac", 2), ("pmd", 3), ("reviewer", 1)], "provider string, trust_rank int")
    q = {r["provider"]: r for r in source_quality(f, g, p).collect()}
    assert q["reviewer"]["specificity"] < q["pmd"]["specificity"] and q["reviewer"]["sensitivity"] < q["pmd"]["sensitivity"]
    kept = {(r["group_key"], r["value"]) for r in true_values(f, g, p).where("field_name = 'title'").collect()}
    assert all((f"g{k:02}a", f"right {k}") in kept for k in range(60)) and not any(v.startswith("wrong") for _, v in kept)
    by_truth = {(r["group_key"]): r["value"] for r in survivors(f, g, p, policy=BY_TRUTH).where("field_name = 'title'").collect()}
    assert all(by_truth[f"g{k:02}a"] == f"right {k}" for k in range(60))
    by_trust = {(r["group_key"]): r["finding_id"] for r in survivors(f, g, p).where("field_name = 'title'").collect()}
    assert all(v.endswith("c") for v in by_trust.values())


def test_present_ids(spark):
    g = spark.createDataFrame([("a", ["b", "x"], "r"), (None, None, "r"), ("x", [], "r")], GROUP)
    f = spark.createDataFrame([finding("a"), finding("b")], FINDING)
    assert sorted(tuple(r) for r in present_ids(g, f).collect()) == [("a", "a"), ("a", "b")]
