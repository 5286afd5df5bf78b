"""Places, stated prices, payloads and records on fixtures."""

from pyspark.sql import functions as F

from fieldmill.functions import facts, places
from fieldmill.operators import records
from fieldmill.plans.records import AREAS, MARKS, NOISE
from fieldmill.plans.spec import from_criteria


def values(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_areas(spark):
    texts = ["OLD  town", "district old-town", "Old Town, Station", "Station / Station", "my oldtown flat", "an lk flat", "lk, Oakdale", "", None]
    want = ["riverton:old_town", None, None, "oakdale:station", "riverton:old_town", None, "oakdale:lake_side", None, None]
    got = values(spark, lambda c: places.find_area(c, AREAS, NOISE), texts)
    assert got[0] == want[0] and got[2:] == want[2:]
    assert values(spark, lambda c: places.official_area(c, AREAS, "district"), ["district old-town", "near old town", "lakeside", None]) == ["riverton:old_town", None, None, None]
    assert places.search_names([" oldtown ", "nowhere", "Old Town"], AREAS) == ["oldtown", "Old Town", "District Old Town", "old quarter", "nowhere"]
    assert values(spark, lambda c: places.landmarks(c, MARKS, "oakdale"), ["clock tower, long pier", "pi", None]) == [["pier"], [], []]


def test_prices(spark):
    texts = ["Rent $300/month, water $80", "water $80\nmonthly rent: $1,250.50", "villa 369USD/ Villa per month", "119$/1 ខែ", "មួយខែ300$", "USD 450", "KHR 900,000", "$5 per person", "electricity 0.25$/kwh", "$300", "", None]
    got = values(spark, facts.source_price, texts)
    assert [tuple(x) if x else None for x in got] == [(300, "USD"), (1250.5, "USD"), (369, "USD"), (119, "USD"), (300, "USD"), (450, "USD"), (900000, "KHR"), None, None, None, None, None]
    assert values(spark, facts.monthly_prices, ["rent: 300$, or $280 per month", "$20 monthly", None])[:2] == [[280.0, 300.0], []]
    assert values(spark, facts.asking_prices, ["asking price: $90,000, deposit $500", ""]) == [[90000.0], []]
    df = spark.createDataFrame([(300.0, "rent is 300 or 2,400 a year"), (2400.0, "rent is 300 or 2,400 a year"), (24.0, "2,400 or 240"), (None, "1"), (1.0, None)], "v double, t string")
    assert [r[0] for r in df.select(facts.grounded(F.col("v"), F.col("t"))).collect()] == [300.0, 2400.0, None, None, None]


def test_payloads(spark):
    texts = ['{"city": 5, "query": " a ", "locations": ["x", " y "], "bedrooms": [1, "2"], "maxPrice": 1.5, "sort": "best"}', '{"query": "' + "q" * 161 + '", "locations": ["x", ""], "bathrooms": [], "hasPool": "yes"}', "[1]", "{", None]
    got = values(spark, facts.search_context, texts)
    assert (got[0]["city"], got[0]["query"], got[0]["locations"], got[0]["bedrooms"], got[0]["max_price"], got[0]["sort"]) == (None, "a", ["x", "y"], None, None, None)
    assert got[1]["query"] is None and got[1]["locations"] is None and got[1]["bathrooms"] == [] and all(v is None for r in got[2:] for v in r)
    wish = lambda c: facts.demand_facts(c, ("Condo",), {"flat": "Condo"})
    got = values(spark, wish, ['{"budget_min": 500, "budget_max": 300, "bedrooms_min": 0, "move_in_date": "2024-13-01", "currency": "USD", "people_count": 0, "areas": ["a", "a", " "]}', '{"currency": "USD", "budget_is_approximate": true}', "[]", None])
    a, b = got[:2]
    assert (a["budget_min"], a["budget_max"], a["bedrooms_min"], a["move_in"], a["currency"], a["people"], a["areas"]) == (300, 500, 0, None, "USD", None, ["a"])
    assert (b["currency"], b["approximate"], b["types"]) == (None, False, []) and got[2:] == [None, None]


def test_records(spark):
    photos = values(spark, records.payload_photos, ['{"images": ["a", {"src": "b"}, {"x": 1}, "", "a"]}', '{"photos": []}', "broken", None])
    assert photos == [["a", "b"], [], [], []]
    assert values(spark, records.chat_link, ["@some_one", "https://t.me/some_one", "call me", "", None]) == ["https://t.me/some_one", "https://t.me/some_one", None, None, None]
    rows = spark.createDataFrame([(1, None), (2, 5), (3, None)], "id int, beds int")
    out = records.enriched(rows, {"beds": F.when(F.col("id") == 1, 2)})
    assert {r["id"]: (r["beds"], len(r["changes"])) for r in out.collect()} == {1: (2, 1), 2: (5, 0), 3: (None, 0)}
    assert {(r["field"], r["n"], r["changed"]) for r in records.enrichment_counts(out).collect()} == {("*", 3, 1), ("beds", None, 1)}
    same = records.parity({"x": rows, "y": rows.where("id > 1"), "z": rows.where("id > 9")}, "id").collect()
    assert [tuple(r) for r in same] == [("x", "y", 2, 1, 0), ("x", "z", 0, 3, 0), ("y", "z", 0, 2, 0)]


def test_criteria_in_dollars():
    spec = from_criteria({"min_price": 12.34, "max_price": None, "locations": ["oldtown", "Old Town"]}, lambda x: places.search_names(x, AREAS), limit=5)
    assert (spec.min_price, spec.max_price, spec.locations, spec.limit) == (1234, None, ("oldtown", "Old Town", "District Old Town", "old quarter"), 5)


def test_client_columns(spark):
    from fieldmill.operators import client

    labels = {"free_wifi": "Free Wi-Fi", "pool": "Swimming Pool"}
    df = spark.createDataFrame([(["Free-WIFI", "pool", "free wifi", "moon"], True), (["pool"], None), (None, True), ([], False)], "a array<string>, p boolean")
    assert [r[0] for r in df.select(client.amenity_labels(F.col("a"), labels, F.col("p"))).collect()] == [["Free Wi-Fi"], ["Swimming Pool"], [], []]
    assert values(spark, client.deposit_months, ['{"deposit_months": 1.5}', '{"deposit_months": 0}', '{"deposit_months": true}', '{"deposit_months": 121}', "[]", "{", None]) == [1.5, None, None, None, None, None, None]
    assert values(spark, client.chat_shown, [" @a_b ", "https://t.me/ab/", "http://t.me/+x", "012345678", "+1 555 123 4567", "", None]) == ["@a_b", "@ab", "+x", "012 345 678", "+1 555 123 4567", "", None]
    assert values(spark, client.phone_shown, ["012345678 | 0961234567", "012345678, +1 555 123 4567", "", None]) == ["012 345 678 / 096 123 4567", "012345678, +1 555 123 4567", "", None]
    assert values(spark, client.international_digits, ["012 345 678", "85512345678", "12345678", "15551234567", "123", None]) == ["85512345678", "85512345678", "85512345678", "15551234567", None, None]


def test_cleaned_rooms(spark):
    texts = ["Villa: 4+1 bedrooms, 2 baths", "3 Bed | 4 Bath", "2 baths\n3 bathrooms", None]
    df = spark.createDataFrame([(i, None, t, None, None, "riverton", None) for i, t in enumerate(texts)], "id int, title string, description string, price int, currency string, city string, location string")
    got = [(r["bedrooms"], r["bathrooms"], [w for w in r["warnings"] if "rooms" in w]) for r in records.cleaned(df, AREAS, MARKS, NOISE).orderBy("id").collect()]
    assert got == [(None, 2, ["bedrooms_conflict"]), (3, 4, []), (None, None, ["bathrooms_conflict"]), (None, None, [])]
