import random
from collections import defaultdict

from tallyloom.operators import codeblocks, joins, routing
from tallyloom.operators.scale import running_total, salt_of, successor


def test_running_total_with_a_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 else rnd.choice("ab"), i, rnd.randrange(9)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, id int, v int").withColumn("salt", salt_of("id", buckets=16))
    got = running_total(df, ["k"], "salt", ["id"], "v", "before", "all").collect()
    by = defaultdict(list)
    for r in got:
        by[r["k"]].append(r)
    for group in by.values():
        group.sort(key=lambda r: (r["salt"], r["id"]))
        total = 0
        for r in group:
            assert r["before"] == total
            total += r["v"]
        assert {r["all"] for r in group} == {total}


def test_running_total_empty_and_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5)], "k string, id int, v int").withColumn("salt", salt_of("id", buckets=1))
    assert sorted((r["id"], r["before"]) for r in running_total(df, ["k"], "salt", ["id"], "v", "before").collect()) == [(1, 0), (2, 0)]
    assert running_total(df.limit(0), ["k"], "salt", ["id"], "v", "before").count() == 0


def test_successor_over_gaps_and_blocks(spark):
    numbers = [1, 2, 5, 1023, 1024, 5000]
    df = spark.createDataFrame([("r", n) for n in numbers] + [("s", 7)], "repo string, n int")
    got = {(r["repo"], r["n"]): r["next"] for r in successor(df, "repo", "n", "next").collect()}
    assert got == {("r", a): b for a, b in zip(numbers, [*numbers[1:], None])} | {("s", 7): None}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_pairs_join_small_rows_only(spark, monkeypatch):
    """Common and rare members, words over several cells; no member list is broadcast or joined, whatever its estimate."""
    rnd = random.Random(5)
    sets = {f"i{n}": [f"m{k}" for k in range(150) if rnd.random() < (0.7 if k < 100 else 0.02)] for n in range(60)} | {"none": [], "one": ["m0"]}
    df = spark.createDataFrame([(k, [*v, None, *v[:1]]) for k, v in sets.items()] + [(None, ["m0", "m1"])], "item string, members array<string>")
    want = {least: {(a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= least} for least in (1, 2, 50)}
    for cell in (joins.CELL if hasattr(joins, "CELL") else 0, 7):
        monkeypatch.setattr(joins, "CELL", cell, raising=False)
        for least, pairs in want.items():
            got = joins.overlap_pairs(df, "item", "members", least)
            assert {tuple(r) for r in got.collect()} == pairs and got.count() == len(pairs)
    plan = plan_of(got)
    assert "BroadcastHashJoin" not in plan and "array_intersect" not in plan
    assert joins.overlap_pairs(df.limit(0), "item", "members", 2).count() == 0


def test_unused_members_shuffle_no_words(spark):
    """Names are counted in their own file only, in strings and comments too; no words leave the pass over the texts."""
    files = [
        ("a", "class A { private int n; private void used() { n(); } // used\n }"),
        ("b", 'class B { private int x; private int used; private void größe() { } String s = "x"; }'),
        ("c", "class C { private void both() { } private int both; private Map<String, A> lone = make(); }"),
        ("d", None),
        ("e", ""),
    ]
    got = codeblocks.unused_members(spark.createDataFrame(files, "id string, code string"), "id", "code")
    assert sorted(map(tuple, got.collect())) == [("b", "field", "used"), ("c", "field", "lone")]
    plan = plan_of(got)
    assert "Join" not in plan and "Exchange" not in plan


def test_full_routes_score_like_pairs_once(spark, monkeypatch):
    """Tasks that say the same and entries that score alike are scored once; the routes are those of all pairs."""
    rnd = random.Random(11)
    words = ["cache", "layer", "slow", "audit", "table", "07"]
    texts = [" ".join(rnd.sample(words, rnd.randrange(1, 4))) for _ in range(6)] + ["xcache layery"]
    tasks = [(n, texts[n % 7], texts[n % 7].split(), ["perf", None][n % 7 % 2]) for n in range(70)]
    entries = [
        (f"e{n:02}", ["the", *rnd.sample(words, 2), f"n{n}"] if n % 3 else ["cache", "slow", f"n{n}"], ["Cache  Layer"] if n % 3 else [], ["audit table"] if n % 5 == 0 else None, "Perf" if n % 4 else "db", ["active", "deprecated", "blocked", None][n % 11 % 4], [80.0, None, 200.0][n % 13 % 3], 100, "e00" if n % 2 else None)
        for n in range(60)
    ]
    schema = "entry_id string, surface array<string>, include array<string>, exclude array<string>, category string, status string, score double, root_lines int, replacement string"

    def scored(task, entry):
        _, text, own, kind = task
        _, surface, include, exclude, category, status, past, root, other = entry
        if status == "blocked" or status == "deprecated" and other or (exclude and ("audit table" in text or "audit" in text and "table" in text)):
            return None
        tag = min(1.0, len(set(surface) & set(own)) / 2)
        trigger = float(bool(include) and ("cache layer" in text or {"cache", "layer"} <= set(own)))
        part = float(category.lower() == kind)
        return round(tag * 0.45 + trigger * 0.25 + part * 0.15 + min(1.0, (past or 0) / 100) * 0.1 + 0.75 * 0.05, 6) if max(tag, trigger, part) > 0 else None

    want = set()
    for task in tasks:
        found = sorted((-x, e[0]) for e in entries if (x := scored(task, e)) is not None)
        want |= {(task[0], e, place) for place, (x, e) in enumerate(found[:5], 1) if -x >= 0.12 and x <= 0.45 * found[0][0]}
    seen, banded_top = [], routing.banded_top
    monkeypatch.setattr(routing, "banded_top", lambda rows, *a: (seen.append(rows.count()), banded_top(rows, *a))[1])
    got = routing.full_routes(spark.createDataFrame(tasks, "task_id int, task string, tokens array<string>, kind string"), spark.createDataFrame(entries, schema))
    assert {(r["task_id"], r["entry_id"], r["place"]) for r in got.collect()} == want and {r[0] for r in want if r[0] % 7 == 6}
    # 14 askings (7 texts, with and without a kind at most), five profiles of five entries each.
    assert seen[0] <= 14 * 25
