"""Findings of a review of larger tables: what failed there on small tables that have the same cause."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldmill.operators import dedupe, pairing, publication, shaping

DIR = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def run(spark, folder, name, **tables):
    for t, rows in tables.items():
        rows.write.parquet(f"{folder}/{t}.parquet")
    return entry.queries()[name](spark, str(folder))


def test_or_join_shuffles_no_joined_rows_where_the_parts_are_apart(spark):
    left = spark.createDataFrame([(1, 7), (2, 7), (3, None), (3, None)], "a long, n long")
    right = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "b long, m long")
    out = shaping.or_join(left, right, [("a", "b"), ("n", "m")], ["a", "b"])
    assert sorted(map(tuple, out.collect())) == [(1, 1), (2, 1), (2, 2), (3, 3)]
    assert plan(out).startswith("Union")
    twice = left.unionByName(spark.createDataFrame([(1, 8)], left.schema))  # a alone no longer tells rows apart
    out = shaping.or_join(twice, right, [("a", "b"), ("n", "m")], ["a", "b"])
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_filters_that_ask_for_the_same_have_their_first_rows_found_once(spark):
    assert "Aggregate [rooms" in plan(entry.queries()["topn_per_filter"](spark, DIR))


def test_a_users_equal_filters_are_joined_as_one(spark):
    assert plan(entry.queries()["theta_saved_filters"](spark, DIR)).count("Aggregate [") == 2


def events(spark, user):
    return spark.range(10).select(F.col("id").alias("event_id"), F.lit(user).cast("long").alias("user_id"))


def test_integers_of_64_bits(spark, tmp_path):
    user = 12_345_678_901_234_567
    got = {r["event_id"]: r["cents"] for r in run(spark, tmp_path, "strict_numbers", events=events(spark, user)).collect()}
    assert got == {i: user * 100 if i % 5 == 0 else None for i in range(10)}
    df = spark.createDataFrame([("9223372036854775807",), ("9223372036854775808",), ("-9223372036854775808",)], "v string")
    assert [r[0] for r in df.select(publication.strict_integer(F.col("v"), most=(1 << 63) - 1)).collect()] == [(1 << 63) - 1, None, None]
    assert [r[0] for r in df.select(publication.strict_integer(F.col("v"))).collect()] == [None] * 3


def test_a_page_behind_the_last_match_is_empty_at_any_size(spark, tmp_path):
    parts = spark.range(1, 70_001).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(4).alias("p_size"), F.lit(915.0).alias("p_retailprice"))
    (row,) = run(spark, tmp_path, "total_of_an_empty_page", part=parts).collect()
    assert row["id"] is None and row["total"] == sum(k % 9 > 0 and k % 11 > 0 for k in range(1, 70_001)) > 50_000


def test_equal_saved_searches_are_matched_as_one(spark):
    assert "Aggregate [" in plan(entry.queries()["saved_search_matches"](spark, DIR))


def test_a_range_whose_bounds_meet_stays_a_range(spark, tmp_path):
    rows = spark.range(2).select(F.col("id").alias("event_id"), F.lit(400).cast("long").alias("user_id"))
    for r in run(spark, tmp_path, "demand_wishes", events=rows).collect():
        assert (r["low"], r["high"], r["target"], r["approximate"]) == (500.0, 500.0, None, False)


@pytest.mark.parametrize("name", ["raw_to_record", "part_fact_policy", "clean_pictures", "advert_restrictions", "advert_spam", "demand_wishes"])
def test_costly_expressions_run_in_all_cores(spark, name):
    assert entry.queries()[name](spark, DIR).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_first_of_ranges_meets_stretches_and_not_all_ranges(spark):
    n = 300
    ranges = [(i * 7 % n, i % 2, i % 3, None if i % 11 == 0 else float(i % 20), None if i % 13 == 0 else float(i % 20 + i % 4)) for i in range(n)]
    points = [(p, p % 2, float(p % 25)) for p in range(60)] + [(3, 1, 9.5), (99, 0, None)]
    r = spark.createDataFrame(ranges, "ident long, kind long, user long, low double, high double")
    p = spark.createDataFrame(points, "p long, k long, v double")
    want = {}
    for a, k, v in points:
        for i, kind, user, low, high in ranges:
            if v is not None and k == kind and (low is None or v >= low) and (high is None or v <= high):
                want[a, user] = min(i, want.get((a, user), i))
    got = pairing.first_of_ranges(p, "p", r, [("k", "kind")], ["user"], "v", "low", "high", "ident").collect()
    assert sorted(map(tuple, got)) == sorted((*k, i) for k, i in want.items())
    heavy = spark.range(20_000).select(F.col("id").alias("ident"), F.lit(0).cast("long").alias("kind"), F.lit(0).cast("long").alias("user"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    assert [tuple(x) for x in pairing.least_of_ranges(heavy, ["kind", "user"], "low", "high", "ident").select("ident").collect()] == [(0,)]  # every point met 20,000 ranges before


def test_greedy_matching_sends_nothing_through_the_driver(spark, monkeypatch):
    plans, cut = [], pairing._cut
    monkeypatch.setattr(pairing, "_cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.8), (2, 2, 0.7)], "a long, b long, score double")
    assert sorted(map(tuple, pairing.greedy_pairs(pairs).collect())) == [(1, 1, 0.9), (2, 2, 0.7)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_near_stage_takes_candidates_from_the_simhash_links(spark, monkeypatch):
    import corpus_pipeline
    from fieldmill.llm import simhash

    found, whole = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: found.append(whole(fps)) or found[-1])
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), " ".join(words)]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, DIR).collect()) == [1, 3]
    pairs = {tuple(r) for r in simhash.fingerprint_pairs(docs, "doc_id", "text").collect()}
    assert len(found) == 2 and (4, 1) in pairs


def test_hashes_are_looked_up_without_a_broadcast_in_bands_of_all_64_bits(spark):
    base = 0x0123456789ABCDEF
    flips = [0, 0b11111, 0b111111, 0b111 << 60, 0b10101 << 40]
    df = spark.createDataFrame([(i, base ^ f if (base ^ f) < 1 << 63 else (base ^ f) - (1 << 64)) for i, f in enumerate(flips)], "id long, hash long")
    out = dedupe.band_pairs(df, 5)
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(flips) for j, b in enumerate(flips) if i < j and (a ^ b).bit_count() <= 5}
    assert {tuple(r) for r in out.collect()} == want
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_pretokens_that_recur_are_encoded_once(monkeypatch):
    from fieldmill.llm import tokens

    asked = []
    memo = tokens.Memo(lambda words: asked.extend(words) or [w.encode() for w in words])
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    for i in range(40):
        new = [f"w{i}-{k}" for k in range(20)]
        assert memo.of(["the", *new]) == [b"the", *(w.encode() for w in new)]
        assert len(memo) + len(memo.older) <= 2 * (50 + 21)
    assert asked.count("the") == 1 and len(asked) == 801


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    from fieldmill.operators.components import _cut

    rows = spark.range(1000).repartition(5)
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    cut = _cut(rows)
    assert files() <= before and cut.count() == 1000



def test_searches_of_a_page_are_dealt_over_all_cores(spark):
    plan_ = entry.queries()["saved_search_page"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(filter_id" in x and "REPARTITION_BY_NUM" in x for x in plan_.splitlines())


def test_a_chains_pointers_are_followed_within_ranges_of_its_scores(spark, monkeypatch):
    cuts, cut = [], pairing._cut
    monkeypatch.setattr(pairing, "_cut", lambda df: cuts.append(1) or cut(df))
    n = 3000
    links = [((i, i + 1) if i % 2 else (i + 1, i)) + (float(i),) for i in range(1, n)]
    chain = spark.createDataFrame(links, "a long, b long, score double")
    got = sorted(map(tuple, pairing.greedy_pairs(chain, 1.0).collect()))
    assert got == sorted(x for x in links if (n - 1 - x[2]) % 2 == 0)
    assert len(cuts) <= 15  # a path of n nodes took log2(n) checkpoints of all nodes before


def test_token_output_splits_in_larger_batches_and_words_are_shown_as_the_model_has_them(spark, tmp_path):
    import public_tokenizers
    from fieldmill.llm import packing, token_output
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    words = ["plain", " word", "  ", "\t", "a\x7fb", "\x00", "größe", " 漢字", "!?", " 12", "x" * 40]
    whole = Tokenizer.from_str(text)
    assert [list(memoryview(x).cast("I")) for x in packing.encoder(text)[1].many(words)] == [whole.encode(w, add_special_tokens=False).ids for w in words]
    docs = spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string")
    assert token_output.tokenised(docs, path).count() == 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1600  # 800 before


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_components_equal_those_of_the_rounds_whatever_is_near(spark, monkeypatch, kind):
    import random

    from fieldmill.operators import components

    rng, n = random.Random(7), 400
    ids = list(range(n)) if kind == "long" else [f"é{i}" if i % 3 else f"z{i}" for i in range(n)]
    pick = lambda i: ids[min(n - 1, i // 20 * 20 + rng.randrange(21))]
    rows = [(ids[i], pick(i), rng.choice([None, "hot", str(i // 20)])) for i in range(n) for _ in range(rng.randrange(3))] + [(ids[5], ids[5], "x"), (None, ids[6], "x"), (ids[7], None, None)]
    edges = spark.createDataFrame(rows, f"a {kind}, b {kind}, near string").repartition(5)
    want = sorted(map(tuple, components.connected_components(edges, "a", "b").collect()))
    for most in (3, 100_000):
        monkeypatch.setattr(components, "UNITED_EDGES", most)
        assert sorted(map(tuple, components.near_components(edges, "a", "b", "near").collect())) == want
    assert components.near_components(edges.limit(0), "a", "b", "near").count() == 0


def test_components_of_equal_near_take_no_rounds_and_edges_are_worked_out_once(spark, monkeypatch):
    from fieldmill.operators import components

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    edges = spark.range(3000).selectExpr("id AS a", "id + if(id % 10 < 9, 1, 0) AS b", "id div 10 AS near").mapInPandas(counted, "a long, b long, near long")
    of = components.connected_components(edges, "a", "b")
    want = {i: i // 10 * 10 for i in range(3000)}
    assert dict(map(tuple, of.collect())) == want and seen.value == 3000  # twice before: for the nodes again
    monkeypatch.setattr(components, "connected_components", None)
    assert dict(map(tuple, components.near_components(edges, "a", "b", "near").collect())) == want and seen.value == 6000


def test_event_clusters_are_mended_in_few_checkpoints(spark, monkeypatch):
    from fieldmill.operators import components
    from fieldmill.plans import pairing as plans

    cuts, cut = [], components._cut
    for module in (components, pairing, plans):
        monkeypatch.setattr(module, "_cut", lambda df: cuts.append(1) or cut(df))
    out = entry.queries()["mended_event_clusters"](spark, DIR)
    assert out.count() == 10_000 and len(cuts) <= 16  # 21 before


def test_a_mended_cluster_takes_two_rounds_of_look_ups(spark, tmp_path):
    # A new item joins two old clusters, both chains: their far ends are reached with the first round.
    chain = lambda k, n: [(k + i, f"s{k + i + j}") for i in range(n) for j in (0, 1)]
    signals = [*chain(0, 6), *chain(100, 6), *chain(200, 6), (500, "s1"), (500, "s105"), (500, "s105"), (501, None), (None, "s3")]
    index = pairing.SignalIndex(spark, spark.createDataFrame(signals, "id long, signal string"))
    assert index.rows().count() == 3 * 12 + 2
    old = spark.createDataFrame([(k + i, k) for k in (0, 100, 200) for i in range(6)], "id long, cluster long")
    got = {r["id"]: r["cluster"] for r in pairing.mended_clusters(index, spark.createDataFrame([(500,)], "id long"), old).collect()}
    assert got == {k + i: {100: 0}.get(k, k) for k in (0, 100, 200) for i in range(6)} | {500: 0}
    assert len(index.read) == 4  # seven before
    # Without old clusters, chains of signals are followed all the same.
    assert {r["id"] for r in pairing.frontier(index, spark.createDataFrame([(0,)], "id long"), old.limit(0)).collect()} == {*range(6), 500, *range(100, 106)}
