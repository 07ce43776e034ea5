"""Percentiles, packing, mixing."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.mixing import default_schedules, integrated, mixture, shares
from tallyloom.llm.packing import best_fit, fill, pack
from tallyloom.llm.percentiles import latest_rows, merge, percentiles, value_counts
from tallyloom.llm.tokens import token_count

PROBS = (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))


def exact(values, share):
    ordered = sorted(values)
    return ordered[max(math.ceil(share * len(ordered) - 1e-9), 1) - 1]


def rows_of(seed, n):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot", "hot", "b", None]), rnd.choice([None, -1, 0, 0, 7, rnd.randrange(10**7)]), rnd.randrange(3)) for _ in range(n)]


def test_percentiles_exact_with_ties_nulls_and_parts(spark):
    rows = rows_of(1, 3000)
    df = spark.createDataFrame(rows, "g string, v bigint, day int")
    by = defaultdict(list)
    for g, v, _ in rows:
        if v is not None and v >= 0:
            by[g].append(v)
    parts = [value_counts(df.where(f"day = {d}"), ["g"], "v") for d in range(3)]
    got = {r["g"]: r for r in percentiles(merge(["g"], *parts), ["g"], PROBS).collect()}
    assert set(got) == set(by)
    for g, values in by.items():
        assert got[g]["n"] == len(values)
        assert [got[g][p] for p, _ in PROBS] == [exact(values, s) for _, s in PROBS]


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_percentile_error_is_bounded(spark, error):
    rows = [(v,) for v in [0, 1, 2, 3, *(random.Random(4).randrange(1, 10**9) for _ in range(2000))]]
    df = spark.createDataFrame(rows, "v bigint")
    counts = value_counts(df, [], "v", error)
    got = percentiles(counts, [], PROBS).first()
    for name, share in PROBS:
        x = exact([v for v, in rows], share)
        assert got[name] <= x < got[name] * (1 + error) + 1


def test_percentiles_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "g string, v bigint, n int, value int, day int")
    assert percentiles(value_counts(df, ["g"], "v"), ["g"]).count() == 0
    one = spark.createDataFrame([("a", 5, 1, 2, 3)], "g string, v bigint, n int, value int, day int")
    assert percentiles(value_counts(one, ["g"], "v"), ["g"], PROBS).first().asDict() == {"g": "a", "n": 1, "p01": 5, "p50": 5, "p99": 5}
    nans = spark.createDataFrame([("a", float("nan")), ("a", 2.0)], "g string, v double")
    assert percentiles(value_counts(nans, ["g"], "v"), ["g"], PROBS).first()["n"] == 1


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 2, 4), (None, 1, 1)], "k int, at int, v int")
    assert [tuple(r) for r in latest_rows(df, "k", "at", ["v"]).collect()] == [(1, 4)]


# --- packing ----------------------------------------------------------------------------------------------------------
def brute_best_fit(lengths, capacity):
    boxes = []
    for length in sorted(lengths, reverse=True):
        fits = [(space, i) for i, space in enumerate(boxes) if space >= length]
        if fits:
            space, i = min(fits)
            boxes[i] -= length
        else:
            boxes.append(capacity - length)
    return boxes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_over_counts_is_best_fit_decreasing(lengths):
    runs, used = best_fit(Counter(lengths).items(), 30)
    boxes = defaultdict(int)
    seen = Counter()
    for length, first, last, each, box in runs:
        for rank in range(first, last + 1):
            boxes[box + (rank - first) // each] += length
            seen[length] += 1
    assert seen == Counter(lengths)
    assert all(v <= 30 for v in boxes.values()) and set(boxes) == set(range(1, used + 1))
    assert sorted(30 - v for v in boxes.values()) == sorted(brute_best_fit(lengths, 30))


def test_pack_places_every_piece_once(spark):
    rnd = random.Random(5)
    docs = [(i, rnd.choice([0, None, 7, 7, 7, 7, rnd.randrange(1, 300)]), "x") for i in range(400)] + [(None, 5, "x")]
    df = spark.createDataFrame(docs, "doc_id int, size int, container string")
    limits = spark.createDataFrame([(1, 64), (2, 512), (2, 100), (3, 0), (None, 9), (4, None)], "limit_id int, capacity_tokens int")
    got = pack(df, limits).collect()
    for limit, capacity in ((1, 64), (2, 512)):
        mine = [r for r in got if r["limit_id"] == limit]
        total, load = defaultdict(int), defaultdict(int)
        for r in mine:
            total[r["doc_id"]] += r["length"]
            load[r["container"]] += r["length"]
            assert r["capacity"] == capacity and r["container"] >= 1
        assert dict(total) == {i: s or 0 for i, s, _ in docs if i is not None}
        assert max(load.values()) <= capacity
        pieces = Counter(r["doc_id"] for r in mine)
        assert all(n == max(1, math.ceil((docs[i][1] or 0) / capacity)) for i, n in pieces.items())
    assert {r["limit_id"] for r in got} == {1, 2}
    report = {r["limit_id"]: r for r in fill(pack(df, limits)).collect()}
    assert report[1]["containers"] >= report[1]["least_containers"] and report[1]["filled"] > 0.97


def test_pack_empty(spark):
    df = spark.createDataFrame([], "doc_id int, size int")
    limits = spark.createDataFrame([(1, 64)], "limit_id int, capacity_tokens int")
    assert pack(df, limits).count() == 0
    assert pack(spark.createDataFrame([(1, 3)], "doc_id int, size int"), limits.limit(0)).count() == 0


def test_token_count(spark):
    cases = {"Hello, world!": 4, "漢字 ab": 3, "": 0, None: 0, " \n\t": 0, "a_b": 3, "$5": 2, "zero​width": 1, "naïve café": 2, "한국어 x": 2}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, n int")
    assert [r for r in df.select("t", "n", token_count(df["t"]).alias("c")).collect() if r["n"] != r["c"]] == []


# --- mixing -----------------------------------------------------------------------------------------------------------
TARGETS = "source string, weight double, max_repeats int"


def documents(spark, n=600):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["Big", "big ", "big", "small", "none", None]) if i % 3 else "BIG", rnd.randrange(0, 50), "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id int, source string, size int, position string")


def test_mixture_meets_shares_and_caps(spark):
    rows, df = documents(spark)
    targets = spark.createDataFrame([("big", 3.0, 1), ("small", 1.0, 4), ("absent", 6.0, 2), ("zero", 0.0, 1), (None, 1.0, 1)], TARGETS)
    mixed = mixture(df, targets)
    got = mixed.collect()
    uses = Counter(r["doc_id"] for r in got)
    held = {i: s for i, _, s, _ in rows}
    source = {i: (x or "").strip().lower() for i, x, _, _ in rows}
    assert all(source[i] in ("big", "small") and held[i] > 0 for i in uses)
    assert max(n for i, n in uses.items() if source[i] == "big") == 1 and max(uses.values()) <= 4
    tokens = defaultdict(int)
    for r in got:
        tokens[r["source"]] += r["tokens"]
    assert abs(tokens["big"] / sum(tokens.values()) - 0.75) < 0.01
    assert [r["position"] for r in got] == sorted(r["position"] for r in got) and 0 <= got[0]["position"] and got[-1]["position"] <= 1
    # A pass begins again only when the one before has been used up.
    for s in ("big", "small"):
        alive = [i for i in held if source[i] == s and held[i] > 0]
        most = max(uses.get(i, 0) for i in alive)
        assert min(uses.get(i, 0) for i in alive) >= most - 1
    report = {r["source"]: r for r in shares(mixed, df, targets).collect()}
    assert report["absent"]["tokens"] == 0 and report["none"]["target_share"] == 0 and abs(report["small"]["actual_share"] - 0.25) < 0.01


def test_shares_hold_the_null_source(spark):
    rows, df = documents(spark)
    targets = spark.createDataFrame([("big", 3.0, 1), ("small", 1.0, 4), (None, 1.0, 1)], TARGETS)
    report = {r["source"]: r for r in shares(mixture(df, targets), df, targets).collect()}
    alone = [s for _, x, s, _ in rows if x is None]
    assert report[None]["documents"] == len(alone) and report[None]["held_tokens"] == sum(alone) > 0
    assert report[None]["target_share"] == report[None]["tokens"] == 0
    assert sum(r["held_tokens"] for r in report.values()) == sum(s for _, _, s, _ in rows)


def test_curriculum_follows_the_schedule(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 10) for i in range(4000)], "doc_id int, source string, size int")
    targets = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], TARGETS)
    got = mixture(df, targets, schedules={"a": [2.0, 0.0], "b": [0.0, 2.0]}).collect()
    first = [r["source"] for r in got if r["position"] < 0.1]
    # The share of a in the first tenth is the integral of 2 - 2t against that of 2t.
    assert abs(first.count("a") / len(first) - 0.95) < 0.03
    late = [r["source"] for r in got if r["position"] > 0.9]
    assert abs(late.count("b") / len(late) - 0.95) < 0.03


def test_schedules():
    shapes = default_schedules([("a", 0.7, 1), ("b", 0.3, 4)])
    for t in (0, 1):
        assert abs(0.7 * shapes["a"][t] + 0.3 * shapes["b"][t] - 1) < 1e-9
    assert all(min(s) >= 0 for s in shapes.values())
    last = integrated([1.0, 3.0, 2.0])[-1]
    assert abs(last[2] + (last[3] + last[4]) / 2 * last[1] - 1) < 1e-9
    with pytest.raises(ValueError):
        integrated([0.0, 0.0])


def test_mixture_empty(spark):
    _, df = documents(spark, 5)
    targets = spark.createDataFrame([("big", 3.0, 1)], TARGETS)
    assert mixture(df.limit(0), targets).count() == 0
    assert mixture(df, targets.limit(0)).count() == 0
