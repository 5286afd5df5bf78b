from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fieldmill.functions import adverts, media
from fieldmill.operators import matching, monitor, tiers
from fieldmill.sources import pages


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_utilities_and_terms(spark):
    say = lambda f, t: one(spark, f(F.lit(t)))
    assert say(adverts.electricity, "Electricity: $0.25/kWh") == "Fixed Rate ($0.25/kWh)"
    assert say(adverts.electricity, "electric 1,000 riel") == "Fixed Rate (1000៛/kWh)"
    assert say(adverts.electricity, "utilities included") == "Included"
    assert say(adverts.electricity, "EDC 720 riel/kWh, water $5") == "EDC (State Rate) (720៛/kWh)"
    assert say(adverts.water, "Water: $5/person") == "Fixed ($5/person)" and say(adverts.water, "water $0.50/m3") == "Fixed Rate ($0.50/m³)"
    assert say(adverts.water, "nothing") is None and say(adverts.electricity, None) is None
    assert say(adverts.cleaning, "cleaning 2 times a week") == "2x/week" and say(adverts.cleaning, "no cleaning") is None
    assert say(adverts.min_lease_months, "1 year contract") == 12 and say(adverts.min_lease_months, None) is None
    assert one(spark, adverts.deposit_cents(F.lit("2 months deposit"), F.lit(40000))) == 80000
    assert one(spark, adverts.deposit_cents(F.lit("deposit: $500"), F.lit(None).cast("long"))) == 50000
    assert one(spark, adverts.is_spam(F.lit("Honda Dream"), F.lit("motorbike and laptop"))) and not one(spark, adverts.is_spam(F.lit("Apartment"), F.lit("near the motorbike shop, monthly")))
    assert say(adverts.repost_key, "code: AB-123, two bedrooms, $450") == "code|ab123|beds:2|baths:?|usd:450"
    where = lambda c: adverts.geography_status(c, ("riverton",), ("freeland",))
    assert say(where, "Riverton") == "home" and say(where, "Paris") == "out_of_area" and say(where, " ") == "unknown" and say(where, "Freeland") == "unknown"


def test_wording_by_phrases(spark):
    texts = ["Strictly NO pets!", "dogs and cats are not allowed", "no-pets", "Non-smoking flat; no loud music", "smoke-free", "not pet friendly", "No sub-rent, no heavy cooking", "nothing", "ហាមសត្វ", "carpets are fine, no partying", None, ""]
    want = ["no_pets", "no_pets", "", "no_smoking,quiet", "no_smoking", "no_pets", "no_sublease,no_cooking", "", "no_pets", "", "", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.array_join(adverts.restrictions(F.col("t")), ",").alias("x"))
    assert [r["x"] for r in rows.orderBy("i").collect()] == want
    kind = lambda t, c=None: one(spark, adverts.property_type(F.lit(t), F.lit(c).cast("string")))
    assert kind("Studio apartment") == "Studio" and kind("a flathouse, villa") == "Flat House" and kind("two bedrooms") is None and kind("studio", "hotel") == "Hotel Room" and kind("nice", "room") == "Room" and kind(None) is None
    rate = lambda t: one(spark, adverts.cleaning(F.lit(t)))
    assert [rate(t) for t in ("3x/week cleaning", "cleaning service 1 time per month", "2 times cleaning a wk", "Daily cleaning", "maid service", "2 rooms")] == ["3x/week", "1x/month", "2x/week", "daily", "included", None]


def test_edges_of_words_are_ascii(spark):
    score = lambda t: one(spark, adverts.spam_score(F.lit(""), F.lit(t)))
    # an edge needs an ASCII word's character on one side, so entries in other scripts count only beside one
    assert score("$20/night") == 4 and score("$20 /night") == 0 and score("5 новых фото в альбомx") == 0 and score("x_новых фото в альбомx") == 4 and score("STORE added") == 4 and score("anyone can see who's in the group") == 4
    junk = lambda u: one(spark, media.junk(F.lit(u)))
    assert junk("https://e.org/p60x60/a.jpg") and not junk("https://e.org/p60x75/a.jpg") and junk("https://e.org/a?CTP=s40x40") and junk("https://e.org/Avatar.png") and not junk("https://e.org/a.jpg?ctp=s600x600")


def test_liveness(spark):
    live = lambda html, x="7": one(spark, adverts.liveness(F.lit(html), F.lit(x)))
    assert live('<script type="application/ld+json">[{"@type":"Product","sku":7}]</script>') == "alive"
    assert live('<script id="__NUXT_DATA__">[{"id":1,"posted_date":2,"status":3,"available":4},7,"2024-01-02","active",true]</script>') == "alive"
    assert live("this ad was removed") == "dead" and live("") == "unknown" and live("<script type='application/ld+json'>{broken</script>") == "unknown"


def test_media(spark):
    a, b = "https://x1.fbcdn.net/v/1_n.jpg?ctp=s600x600", "https://x2.fbcdn.net/v/1_n.jpg?ctp=s1280x960"
    assert one(spark, media.clean_photos(F.array(F.lit(a), F.lit(b), F.lit("https://e.org/avatar.png"), F.lit(None)))) == [b]
    assert one(spark, media.identity_hash(F.array(F.lit(a)))) == one(spark, media.identity_hash(F.array(F.lit(b), F.lit("no address"))))
    assert one(spark, media.full_size(F.lit("https://e.org/thumbs/s/1.jpg"))) == "https://e.org/uploads/l/1.jpg"
    assert one(spark, media.author_key(F.lit("https://www.f.com/p.php?id=AB"), F.lit(None).cast("string"))) == "fb:ab" and one(spark, media.author_key(F.lit(""), F.lit("Jo  Do!"))) == "name:jo do"
    rows = spark.createDataFrame([('{"a": {"photos": ["https://e.org/x"]}, "b": "https://e.org/y.jpg", "c": "https://e.org/z"}',), ("broken",), (None,)], "j string")
    assert [r["m"] for r in rows.select(media.nested_media("j").alias("m")).collect()] == [["https://e.org/x", "https://e.org/y.jpg"], [], []]
    got = one(spark, media.identifiers(F.lit("call 012 345 678, wa: 098 765 432, t.me/Some_one, a@B.org, property id: ab-12, https://maps.app.goo.gl/x?place_id=P1")))
    assert {(r["type"], r["value"]) for r in got} == {("EMAIL", "a@b.org"), ("MAPS_PLACE_ID", "P1"), ("MAPS_URL", "https://maps.app.goo.gl/x?place_id=P1"), ("PHONE", "+85512345678"), ("PHONE", "+85598765432"), ("PROPERTY_CODE", "AB-12"), ("TELEGRAM", "@some_one"), ("WHATSAPP", "+85598765432")}
    c = one(spark, media.contacts(F.lit("wa: 098 765 432, call 012 345 678")))
    assert (c["phone"], c["whatsapp"]) == ("+85512345678", "+85598765432")


def test_pages(spark):
    feed = '<script id="__G__">[{"total":1,"data":1,"limit":2},[2,4],{"data":3},{"link":"/x-adid-1"},{"data":5},{"link":6},"https://e.org/y-adid-2"]</script>'
    rows = spark.createDataFrame([(1, feed), (2, None), (3, '<script id="__G__">{</script>')], "id long, html string")
    assert [(r["id"], r["link"]) for r in pages.feed_links(rows, "html", "__G__", "-adid-", "https://e.org", 15).collect()] == [(1, "https://e.org/x-adid-1"), (1, "https://e.org/y-adid-2")]
    posts = spark.createDataFrame([('{"d": [{"__typename": "Story", "id": 1, "n": {"comet_sections": {}}}, {"x": {"comet_sections": {}}}]}',), ("[",)], "j string")
    assert pages.nested_posts(posts, "j").count() == 2
    p = one(spark, pages.product(F.lit('<script type="application/ld+json">{"@type":"Product","sku":5,"name":"n","offers":{"price":"$1,200.50","priceCurrency":"USD"}}</script>')))
    assert (p["sku"], p["price"], p["currency"]) == ("5", 120050, "USD")


def test_versions(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    for i in range(3):
        pages.save_version(spark.range(i + 1), folder, keep=2, stamp=f"s{i}")
    assert sorted(x.name for x in (tmp_path / "t").iterdir()) == ["version-s1", "version-s2"]
    e = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))], "id long, ts timestamp")
    pages.append_events(e, f"{tmp_path}/e")
    pages.append_events(e, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").where("day = DATE '2024-01-02'").count() == 2


def test_matching(spark):
    pairs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.85), (2, 11, 0.6), (3, 11, 0.5), (4, 12, 1.1), (5, 12, 1.1)], "a long, b long, score double")
    assert {(r["a"], r["b"]) for r in matching.one_to_one(pairs).collect()} == {(1, 10), (2, 11), (4, 12)}
    assert matching.one_to_one(pairs.limit(0)).count() == 0
    many = lambda x, y: tuple(one(spark, matching.many_hashes(F.array(*map(F.lit, x)).cast("array<bigint>"), F.array(*map(F.lit, y)).cast("array<bigint>"))))
    assert many([0, 1, 1 << 40], [0]) == (3, True) and many([0, -1, 255 << 20], [0, 1 << 50]) == (1, False) and many([0], [1]) == (1, True) and many([], [0]) == (0, False)
    left = spark.createDataFrame([(1, 0), (2, -1)], "id long, hash long")
    assert [(r["a"], r["b"], r["distance"]) for r in matching.audit_pairs(left, left.where("id = 1")).collect()] == [(1, 1, 0)]
    members = spark.createDataFrame([(1, 1, ["x"], [("u", None)], 5), (1, 2, ["y", "x"], [("u", 7), ("v", 8)], 3), (2, 3, [], [], 1)], "g long, id long, identifiers array<string>, photos array<struct<url:string,hash:bigint>>, seen long")
    got = {r["g"]: r for r in matching.candidates(members, "g", "id").collect()}
    assert got[1]["identifiers"] == ["x", "y"] and [tuple(p) for p in got[1]["photos"]] == [("u", 7), ("v", 8)] and (got[1]["first_seen"], got[1]["last_seen"]) == (3, 5) and got[2]["photos"] == []
    key = lambda area, apart, kind, code, cur=False: one(spark, matching.rebound_key(F.lit("k"), F.lit("old"), F.lit(cur), F.lit(area), F.lit(apart), F.lit(kind), F.lit(code)))
    assert key(True, 2, False, False) == "old" and key(True, 2, True, False) not in ("old", "k") and key(False, 2, False, True) != "old" and key(True, 2, True, True, True) == "old"
    assert one(spark, matching.multiset_dice(F.split(F.lit("a a b"), " "), F.split(F.lit("a b b"), " "))) == pytest.approx(4 / 6)
    before = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1)], "k long, v long, w long")
    after = spark.createDataFrame([(1, 2, 1), (2, 1, 2), (3, 2, 1)], "k long, v long, w long")
    assert {r["k"] for r in matching.scope_violations(before, after, "k", before.where("k < 3"), ["v", "w"], ["v"]).collect()} == {2, 3}
    old = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "id long, cluster long")
    new = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "id long, cluster long")
    assert {r["id"]: r["cluster"] for r in matching.kept_cluster_ids(old, new).collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_corroborated(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, 1, words, "j"), (1, 2, words, "k"), (2, 3, words + " 500", "j"), (2, 4, words + " 600", "j"), (3, 5, words, "j"), (4, 6, "short", "j"), (4, 7, "short", "j"), (5, 8, words + " x", "j"), (5, 9, words, "j"), (6, 10, words, None), (6, 11, words + " y", None)]
    got = {r["g"]: r["ok"] for r in matching.corroborated(spark.createDataFrame(rows, "g long, id long, body string, author string"), "g", "id", "body", "author").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_monitor(spark):
    empty = spark.createDataFrame([], "id string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {(r["problem"], r["n"]) for r in monitor.batch_contract(asked, spark.createDataFrame([("a",), ("a",), ("b",), ("x",), (None,)], "id string")).collect()} == {("duplicate", 1), ("unknown", 1), ("missing", 1), ("empty", 1)}
    assert monitor.batch_contract(asked, asked).count() == 0 and monitor.batch_contract(empty, empty).count() == 0
    t = datetime(2024, 3, 1)
    s = spark.createDataFrame([(1, "a", "available", t - timedelta(days=40)), (1, "b", "unavailable", t), (2, "a", "available", t - timedelta(days=3)), (2, "b", "unavailable", t)], "l long, s string, x string, at timestamp")
    assert {r["l"]: r["status"] for r in monitor.availability_fold(s, "l", "s", "x", "at").collect()} == {1: "rented", 2: "available"}
    assert one(spark, tiers.offer_tier(F.lit(None).cast("string"), F.lit("For Rent"), F.lit(0))) == "PROBABLE" and one(spark, tiers.offer_tier(F.lit("rent"), F.lit(None).cast("string"))) == "EXACT"
