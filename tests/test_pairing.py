import random

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import pairing as P
from fieldmill.operators.components import connected_components
from fieldmill.operators.shaping import star_pairs


def greedy(pairs, least):
    used_a, used_b, out = set(), set(), []
    best = {}
    for a, b, s in pairs:
        if None not in (a, b, s) and s >= least:
            best[a, b] = max(s, best.get((a, b), s))
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in used_a and b not in used_b:
            out.append((a, b, s))
            used_a.add(a), used_b.add(b)
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("a", "b", "score").collect())


@pytest.mark.parametrize("seed", range(6))
def test_greedy_matching_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    scores = [0.5, 0.6, 0.7, 0.8] if seed % 2 else [rng.random() for _ in range(999)]
    pairs = [(rng.randrange(25), rng.randrange(25), rng.choice(scores)) for _ in range(rng.choice([40, 120, 400]))] + [(None, 1, 0.9), (1, None, 0.9), (1, 1, None)]
    df = spark.createDataFrame(pairs, "a long, b long, score double")
    assert got(P.greedy_pairs(df)) == greedy(pairs, 0.55)


def test_a_chain_of_ten_thousand_pairs_ends_in_few_rounds(spark):
    # 0-0, 0-1, 1-1, 1-2, ... with rising scores: one pair a round when only mutual best pairs are taken.
    pairs = [((i + 1) // 2, i // 2, 1.0 + i) for i in range(10_000)]
    df = spark.createDataFrame(pairs, "a long, b long, score double")
    out = P.greedy_pairs(df, most_rounds=3)
    assert got(out) == greedy(pairs, 0.55) and out.count() == 5000


def test_no_pairs(spark):
    assert P.greedy_pairs(spark.createDataFrame([(1, 1, 0.1)], "a long, b long, score double")).count() == 0


def test_interval_join_with_open_bounds_one_hot_value_and_shares(spark):
    rng = random.Random(1)
    points = [(i, rng.choice("xy"), 50.0 if rng.random() < 0.5 else rng.choice([None, *map(float, range(-20, 200))])) for i in range(400)]
    bounds = [(i, rng.choice("xyz"), *sorted([float(rng.randrange(-40, 230)), float(rng.randrange(-40, 230))])) for i in range(40)]
    bounds += [(100, "x", None, 50.0), (101, "x", 50.0, None), (102, "y", None, None), (103, "y", 60.0, 40.0), (104, "x", 1e9, 2e9), (105, None, 0.0, 9.0), (106, "x", 50.0, 50.0)]
    p, r = spark.createDataFrame(points, "id long, kind string, v double"), spark.createDataFrame(bounds, "rid long, want string, low double, high double")
    want = sorted((i, j) for i, k, v in points for j, w, low, high in bounds if k == w and v is not None and (low is None or v >= low) and (high is None or v <= high))
    for width, most in ((10.0, 100_000), (7.0, 20), (1000.0, 5)):
        j = P.interval_join(p, r, [("kind", "want")], "v", "low", "high", width, most)
        assert sorted((x["id"], x["rid"]) for x in j.select("id", "rid").collect()) == want
    assert P.interval_join(p.limit(0), r, [("kind", "want")], "v", "low", "high", 5.0).count() == 0


def clusters(spark, signals):
    df = spark.createDataFrame(signals, "id long, signal string")
    of = {r["node"]: r["component"] for r in connected_components(star_pairs(df), "a", "b").collect()}
    return {i: of.get(i, i) for i, _ in signals}


def test_mended_clusters_equal_all_anew_and_untouched_signals_are_not_read(spark):
    rng = random.Random(4)
    signals = [(i, f"s{i // 10}-{rng.randrange(4)}") for i in range(2000) for _ in range(2)]
    before = clusters(spark, signals)
    old = spark.createDataFrame(list(before.items()), "id long, cluster long")
    # 7 leaves its signals for one of 1500's, 3000 is new, 40 loses all.
    after = [(i, s) for i, s in signals if i not in (7, 40)] + [(7, signals[3000][1]), (3000, signals[100][1]), (3000, "s-new")]
    index = P.SignalIndex(spark, spark.createDataFrame(after, "id long, signal string"), buckets=128)
    changed = spark.createDataFrame([(7,), (40,), (3000,), (None,)], "id long")
    result = {r["id"]: r["cluster"] for r in P.mended_clusters(index, changed, old).collect()}
    assert result == clusters(spark, after) | {40: 40}
    touched = P.frontier(index, changed, old).count()
    assert touched < 80 and all(n < 80 for _, n in index.read) and len(index.read) > 4
    plan = index.find("signal", spark.createDataFrame([(signals[0][1],)], "signal string"))
    assert index.read[-1] == ("signal", 1)
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan and plan.count() == sum(x == signals[0][1] for _, x in set(after))


def test_delete_closure_over_several_parents_circles_and_nulls(spark):
    team = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None), (5, 5)], "id long, boss long")
    task = spark.createDataFrame([(10, 3, 20), (11, 4, 20), (12, None, 21), (13, 4, None)], "id long, owner long, plan long")
    plan = spark.createDataFrame([(20, 13), (21, 10), (22, None)], "id long, first long")
    note = spark.createDataFrame([("a", 12), ("b", 13), ("c", None)], "id string, about long")
    tables = {"note": (note, "id"), "task": (task, "id"), "plan": (plan, "id"), "team": (team, "id")}
    refs = [("team", "boss", "team"), ("task", "owner", "team"), ("task", "plan", "plan"), ("plan", "first", "task"), ("note", "about", "task")]
    run = lambda roots: sorted((r["table"], r["id"]) for r in P.delete_closure({t: spark.createDataFrame(ids, "id long") for t, ids in roots.items()}, tables, refs).collect())
    # 1 takes 2 and 3; 3's task 10 takes plan 21, which takes task 12 and its note.
    assert run({"team": [(1,)]}) == [("note", "a"), ("plan", "21"), ("task", "10"), ("task", "12"), ("team", "1"), ("team", "2"), ("team", "3")]
    assert run({"team": [(5,)]}) == [("team", "5")]
    assert run({"plan": [(20,)], "team": [(4,)]}) == [("note", "a"), ("note", "b"), ("plan", "20"), ("plan", "21"), ("task", "10"), ("task", "11"), ("task", "12"), ("task", "13"), ("team", "4")]
    assert run({}) == []
