"""Eligibility, budgets, state and reposts against plain Python."""

import random

from pyspark.sql import functions as F

from fieldmill.operators import analytics, dedupe, publication
from fieldmill.streaming import stateful


def test_fold_by_windows_is_the_streams_step(spark):
    draw = random.Random(4)
    rows = [(k, draw.choice(["ALIVE", "REMOVED", "REMOVED", "UNKNOWN"]), draw.randrange(200) * 1800) for k in range(60) for _ in range(draw.randrange(1, 14))]
    want = {}
    for k in range(60):
        status, first, unknowns, nxt = "NEW", None, 0, None
        for _, kind, at in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if status != "REMOVED":
                status, first, unknowns, nxt = stateful.step(status, first, unknowns, kind, at)
        if any(r[0] == k for r in rows):
            want[k] = (status, first, unknowns, nxt)
    got = {r["id"]: tuple(r)[1:] for r in analytics.fold_states(spark.createDataFrame(rows, "id long, kind string, at long"), "id", "kind", "at").collect()}
    assert got == want and {"REMOVED", "ALIVE", "SUSPECTED"} <= {x[0] for x in got.values()}


def test_greedy_budget_passes_over_what_does_not_fit(spark):
    draw = random.Random(9)
    for budget in (0, 7, 40):
        rows = [(i, draw.randrange(12)) for i in range(300)]
        left, want = budget, set()
        for i, c in rows:
            if c <= left or c == 0:
                want.add(i)
                left -= c
        got = publication.greedy(spark.createDataFrame([*rows, (999, None)], "id long, cost long"), [F.asc("id")], "cost", budget)
        assert {r["id"] for r in got.collect()} == want


def test_an_old_original_is_not_renewed_by_a_copy(spark):
    # listing, id, item, published, first_seen, last_seen, ended, changed, is_current, alive, result
    rows = [
        (1, 1, 1, 10, 10, 20, None, None, True, True, "OK"), (1, 2, 2, 99, 99, 99, None, None, True, True, "OK"),
        (2, 3, 1, 10, 10, 20, None, 95, True, True, "OK"),
        (3, 4, 1, None, 10, 20, None, None, True, True, "OK"),
        (4, 5, 1, 95, 95, 96, 96, None, False, False, "REMOVED"),
        (5, 6, 1, 95, 95, 96, 96, None, False, False, "REMOVED"), (5, 7, 1, 98, 98, 99, None, None, True, True, "OK"),
    ]
    df = spark.createDataFrame(rows, "listing int, id int, item int, published int, first_seen int, last_seen int, ended int, changed int, is_current boolean, alive boolean, result string")
    assert {r["listing"]: r["eligible"] for r in publication.fresh_originals(df, F.lit(100)).collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}


def test_reposts_share_fingerprints_and_identifiers(spark):
    words = "large bright flat with two rooms near the river market and school for rent now".split()
    norm = " ".join(words)
    other = norm.replace("bright", "sunny")
    rows = [(i, f"h{i}", None, f"a{i}", norm, words, []) for i in range(60)] + [(100 + i, f"k{i}", None, f"b{i}", other if i else norm + " again", (other if i else norm + " again").split(), ["PROPERTY_CODE:77"]) for i in range(2)]
    items = spark.createDataFrame(rows, "id long, content_hash string, url string, author string, norm string, tokens array<string>, identifiers array<string>")
    edges = dedupe.repost_edges(items, len(rows))
    got = dedupe.clusters(items, edges).groupBy("cluster").count().collect()
    assert max(r["count"] for r in got) >= 60  # every token is in over 45 items
    assert edges.where("a >= 100 AND b >= 100 AND method = 'property_code'").count() + edges.where("b >= 100 AND a >= 100").count() >= 1


def test_small_functions(spark):
    df = spark.createDataFrame([("  12 ",), ("+7",), ("-1",), ("9007199254740993",), ("1.5",), (None,)], "v string")
    assert [r[0] for r in df.select(publication.strict_integer(F.col("v"), scale=100)).collect()] == [1200, 700, None, None, None, None]
    assert [r[0] for r in df.select(publication.strict_decimal(F.col("v"))).collect()] == [12.0, 7.0, -1.0, 9007199254740992.0, 1.5, None]
    tags = spark.createDataFrame([([" Pool", "wi-fi", "GYM", "wifi", "junk"],)], "t array<string>")
    assert tags.select(publication.canonical_tags(F.col("t"), {"wi-fi": "Wifi"}, ["Pool", "Wifi", "Gym"])).first()[0] == ["Pool", "Wifi", "Gym"]
    pairs = spark.createDataFrame([(1, 2, 0.7, False, True), (1, 3, 0.9, False, True), (1, 4, 0.5, False, False), (1, 5, 0.9, True, True)], "a int, b int, similarity double, accepted boolean, shared_phone boolean")
    assert sorted((r["b"], r["kind"]) for r in publication.diagnostics(pairs).collect()) == [(2, "near_threshold"), (2, "same_agent_different_text"), (3, "near_threshold")]
