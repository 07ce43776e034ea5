import json
from datetime import datetime

from tallyloom.operators.snapshots import changes

ENTRY = "id string, rule_id string, category string, severity string, confidence double, title string, file string, start_line int, end_line int, symbol string, status string, sources array<string>, historical boolean"
SCHEMA = f"repo string, snapshot_no int, received_at timestamp, findings array<string>, entries array<struct<{', '.join(c.replace(' ', ':', 1) for c in ENTRY.split(', '))}>>, extra string"
DAY = datetime(2025, 1, 1)


def key(rule, file="a/b.java", line=1, **more):
    return json.dumps({"rule_id": rule, "file": file, "line": line} | more)


def entry(rule, file="a/b.java", line=1, symbol=None, **over):
    row = {"id": "1", "rule_id": rule, "category": "X", "severity": "LOW", "confidence": 0.5, "title": "t", "file": file, "start_line": line, "end_line": 9, "symbol": symbol, "status": "INFO", "sources": ["pmd", "cpd"], "historical": False} | over
    return tuple(row[c.split()[0]] for c in ENTRY.split(", "))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return sorted((r["repo"], r["snapshot_no"], r["rule_id"], r["change_kind"], tuple(r["changed_fields"])) for r in changes(df).collect())


def test_added_removed_changed_and_gap(spark):
    rows = [
        ("r", 1, DAY, [key("A"), key("B"), key("C")], [entry("A"), entry("B"), entry("C")]),
        ("r", 4, DAY, [key("A"), key("B"), key("D")], [entry("A", severity="HIGH", confidence=0.6), entry("B"), entry("D")]),
    ]
    assert run(spark, rows) == [("r", 4, "A", "changed", ("confidence", "severity")), ("r", 4, "C", "removed", ()), ("r", 4, "D", "added", ())]


def test_spelling_order_and_copies_do_not_count(spark):
    other = entry("A", file=".\\a\\b.java", severity=" low ", title="T", sources=["CPD", "pmd", "pmd"], confidence=0.50001, id="7")
    rows = [
        ("r", 1, DAY, [key("A", symbol=None)], [entry("A")]),
        ("r", 2, DAY, [key("A", file="./a//b.java", symbol=""), key("A")], [other, other]),
    ]
    assert run(spark, rows) == []


def test_unknown_state_null_and_unreadable_keys(spark):
    rows = [
        ("r", 1, DAY, [key("A"), None, "{bad"], None),
        ("r", 2, DAY, [key("A")], [entry("A", severity="HIGH")]),
        ("r", 3, DAY, None, None),
        (None, 1, DAY, [key("A")], None),
        ("s", None, DAY, [key("A")], None),
    ]
    assert run(spark, rows) == [("r", 3, "A", "removed", ())]


def test_last_delivery_counts_and_first_snapshot_has_no_rows(spark):
    late = datetime(2025, 2, 1)
    rows = [("r", 1, late, [key("A")], None), ("r", 1, DAY, [key("B")], None), ("r", 2, DAY, [key("A")], None), ("q", 9, DAY, [key("Z")], None)]
    assert run(spark, rows) == []


def test_same_moment_takes_the_fuller_delivery(spark):
    rows = [("r", 1, DAY, [key("A"), key("B")], None), ("r", 1, DAY, [key("A")], None), ("r", 2, DAY, [key("A"), key("B")], None)]
    assert run(spark, rows) == []


def test_symbol_is_part_of_the_key_and_entry_only_is_no_record(spark):
    rows = [("r", 1, DAY, [key("A", symbol="f")], []), ("r", 2, DAY, [key("A", symbol="g")], [entry("Q")])]
    assert run(spark, rows) == [("r", 2, "A", "added", ()), ("r", 2, "A", "removed", ())]


def test_empty(spark):
    assert run(spark, []) == []
