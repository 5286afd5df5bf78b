import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fieldmill.functions import geo, text
from fieldmill.operators import analytics, dedupe, predicates, shaping
from fieldmill.operators.components import connected_components
from fieldmill.plans.spec import NullPolicy, SearchSpec
from fieldmill.sources import readers
from fieldmill.streaming import stateful


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_prices_sort_with_unknown_last(spark):
    rows = spark.createDataFrame([(1, 10000, 1), (2, 10000, 1), (3, 5000, 1), (4, 0, 1), (5, -100, 1)], "id long, price long, day long")
    got = [r["id"] for r in predicates.search(rows, SearchSpec(sort="price_asc", columns={"date": "day"})).collect()]
    assert got[:3] == [3, 2, 1] and set(got[3:]) == {4, 5}
    got = [r["id"] for r in predicates.search(rows, SearchSpec(sort="price_desc", columns={"date": "day"})).collect()]
    assert got[:3] == [2, 1, 3] and set(got[3:]) == {4, 5}


def test_null_policies(spark):
    rows = spark.createDataFrame([(1, None), (2, 0), (3, 500), (4, 900)], "id long, price long")
    ids = lambda policy: {r["id"] for r in rows.where(predicates.price_between(F.col("price"), 400, 600, policy)).collect()}
    assert ids(NullPolicy.LEGACY) == {3} and ids(NullPolicy.CANONICAL) == {1, 2, 3}


def test_components_match_union_find(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(500, 540)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_text_functions(spark):
    assert one(spark, text.price_cents(F.lit("rent $1,200.50 a month"))) == 120050
    assert one(spark, text.price_cents(F.lit("850 USD"))) == 85000
    assert one(spark, text.price_cents(F.lit("400000 riel"))) == 10000
    assert one(spark, text.price_cents(F.lit("ask"))) is None
    assert one(spark, text.phone_e164(F.lit("012 345 678"))) == "+85512345678"
    assert one(spark, text.phone_e164(F.lit("+855 12 345 678"))) == "+85512345678"
    assert one(spark, text.bedrooms(F.lit("two bedrooms, 1 bath"))) == 2
    assert one(spark, text.bedrooms(F.lit("2 bedrooms or 3 bedrooms"))) is None
    assert one(spark, text.has_pool(F.lit("no pool"))) is False and one(spark, text.has_pool(F.lit("a garden"))) is None
    assert one(spark, text.canonical_url(F.lit("http://www.Example.com/a/?utm_source=x&b=2&a=1#t"))) == "https://example.com/a?a=1&b=2"
    assert one(spark, text.relative_seconds(F.lit("2 days ago"))) == 172800
    assert tuple(one(spark, text.budget(F.lit("$200 - 400")))) == (200, 400)
    assert tuple(one(spark, text.budget(F.lit("200+")))) == (200, None) and tuple(one(spark, text.budget(F.lit("450")))) == (None, 450)
    assert tuple(one(spark, geo.coordinates(F.lit("https://maps.example/@13.36,103.86,17z")))) == (13.36, 103.86)


def test_unnest_words_gives_the_whole_array(spark, tmp_path):
    from fieldmill.plans import catalogue

    texts = {1: "a b c d e", 2: "one", 3: None, 4: " x  y "}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES["unnest_words"](spark, str(tmp_path)).orderBy("doc_id", "pos").collect()]
    assert got == [(i, k, w) for i, t in texts.items() if t is not None for k, w in enumerate(t.split(" "), 1)]


def test_state_machine(spark):
    h = 3600
    rows = [(1, "REMOVED", 0), (1, "REMOVED", 60), (2, "REMOVED", 0), (2, "REMOVED", 6 * h), (3, "REMOVED", 0), (3, "ALIVE", h), (3, "REMOVED", 7 * h), (4, "UNKNOWN", 0), (4, "UNKNOWN", 1), (4, "UNKNOWN", 2)]
    got = {r["id"]: r for r in analytics.fold_states(spark.createDataFrame(rows, "id long, kind string, at long"), "id", "kind", "at").collect()}
    assert [got[i]["status"] for i in (1, 2, 3)] == ["SUSPECTED", "REMOVED", "SUSPECTED"] and got[4]["next_check"] == 2 + 24 * h
    state = ("NEW", None, 0)
    for i, kind, at in rows[2:4]:
        state = stateful.step(*state, kind, at)[:3]
    assert state[0] == "REMOVED"


def test_asof_interval_and_diff(spark):
    t = datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, "v", t), (2, "p", t + timedelta(seconds=60)), (3, "v", t + timedelta(seconds=90))], "id long, k string, ts timestamp").withColumn("u", F.lit(1))
    got = shaping.asof_join(e, ["u"], "ts", F.col("k") == "v", F.col("id"), "seen", "id").collect()
    assert [(r["id"], r["seen"]) for r in got] == [(2, 1)]
    assert {(r["a"], r["b"]) for r in shaping.interval_pairs(e, ["u"], "id", "ts", 60).collect()} == {(1, 2), (2, 3)}


def test_repost_rules(spark):
    texts = ["bright flat near the old market with two rooms and a balcony"] * 2 + ["bright flat near the old market with two rooms and a terrace", "garden house far away"]
    items = spark.createDataFrame([(i, x, "", f"u{i}") for i, x in enumerate(texts)], "id long, norm string, url string, author string")
    items = items.withColumn("content_hash", F.sha2("norm", 256)).withColumn("tokens", text.tokens(F.col("norm")))
    edges = dedupe.repost_edges(items, 4)
    assert {(r["a"], r["b"], r["method"]) for r in edges.collect()} == {(0, 1, "content_hash")}
    assert {r["id"]: r["cluster"] for r in dedupe.clusters(items, edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"posts": [{"id": "1", "text": "x"}, {"id": "2"}]}')
    assert readers.replay(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.txt").write_text('for (;;);{"id": "1", "t": "a"}\nbroken\n{"id": "1", "t": "b"}\n')
    assert readers.guarded_lines(spark, str(tmp_path / "b.txt"), "id string, t string", "id").count() == 1


def test_streams(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([(1, "v", t), (2, "v", t + timedelta(hours=2))], "id long, k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, ts timestamp").parquet(str(tmp_path / "in"))
    q = stateful.activity(stream, "ts", ["k"], "1 hour", late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("act").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) s from act").first()["s"] == 2


def test_cluster_keys_of_any_size_by_one_formula(spark):
    import hashlib

    from fieldmill.operators import dedupe

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, f"c{i % 3}" if i % 5 else "big") for i in range(400)] + [(None, "big"), (None, "empty"), (9999, None)]
        got = {r["cluster"]: r["key"] for r in dedupe.cluster_keys(spark.createDataFrame(rows, "id long, cluster string"), "K").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, c in rows:
        if i is not None and c is not None:
            want.setdefault(c, []).append(i)
    assert got == {c: hashlib.sha256(("K|" + ",".join(map(str, sorted(ids)))).encode()).hexdigest() for c, ids in want.items()}
    assert dedupe.cluster_keys(spark.createDataFrame([], "id long, cluster string"), "K").count() == 0
