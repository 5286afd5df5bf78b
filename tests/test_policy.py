from pyspark.sql import functions as F

from fieldmill.functions import policy
from fieldmill.operators import enrichment


def rows(spark, texts, expr):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_monthly_rent(spark):
    cases = {
        "Rent: $450/month": ("confirmed", 450.0, "USD"), "Rental price USD 1,200 per month, furnished": ("confirmed", 1200.0, "USD"), "Rent: $450": ("unknown", None, None),
        "Monthly rent: 300 USD": ("confirmed", 300.0, "USD"), "Price 900,000 KHR / month": ("confirmed", 900000.0, "KHR"), "price 500 USD": ("unknown", None, None),
        "Rent $450 per month; rent $500 per month": ("conflict", None, None), "Water price $20 per month. Rent $450 monthly": ("confirmed", 450.0, "USD"),
        "Rent $450 per month\nPrice: 450 USD per month": ("confirmed", 450.0, "USD"), "": ("unknown", None, None),
    }
    got = rows(spark, list(cases), policy.monthly_rent(F.col("t")))
    assert [(t, tuple(g)) for t, g in zip(cases, got)] == list(cases.items())


def test_deposit(spark):
    cases = {"Deposit: $300": 300.0, "Security deposit USD 1,000": 1000.0, "deposit 1 month": None, "Rent $450 deposit 1 month": None, "$200 deposit": 200.0, "deposit $200; deposit $300": None, "$300 deposit $450": 450.0, "ប្រាក់កក់ 500$": 500.0, "": None}
    assert dict(zip(cases, rows(spark, list(cases), policy.deposit_amount(F.col("t"))))) == cases


def test_kinds_and_amenities(spark):
    cases = {("Private House", "Apartment for rent\nnice"): ("Apartment", True), ("Private House", "Apartment for rent\nA house"): ("Private House", False), ("studio", "Apartment"): ("Studio", False), (None, "Villa with pool"): ("Private Villa", False), ("Condo", "Condo or villa"): ("Condo", False), (None, "x"): (None, False)}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, m string, t string")
    got = df.select("i", policy.property_type(F.col("m"), F.col("t")).alias("v")).orderBy("i").collect()
    assert [tuple(r["v"]) for r in got] == list(cases.values())
    known = [*policy.AMENITIES, "garden"]
    named = F.array(*[F.lit(x) for x in ("air_conditioner", "ac_all_rooms", "refrigerator", "garden", "moon")])
    got = rows(spark, ["AC in all rooms", "a/c, fridge", "", "no access"], policy.amenities(named, F.col("t"), known))
    assert got == [["ac_all_rooms", "garden"], ["air_conditioner", "refrigerator", "garden"], ["garden"], ["garden"]]


def test_grounded_facts(spark):
    model = F.struct(F.lit("Lovely 4 bedrooms house").alias("title"), F.lit("Quiet. It has 2 bathrooms. Enjoy hot water. Pool (3 baths).").alias("description"), F.lit(999.0).alias("price"), F.lit("USD").alias("currency"), F.lit(4).alias("bedrooms"), F.lit(2).alias("bathrooms"), F.lit("Private House").alias("property_type"), F.lit("house").alias("category"), F.array(F.lit("refrigerator")).alias("amenities"))
    form = F.struct(F.lit(4).alias("bedrooms"), F.lit(3).alias("bathrooms"))
    texts = ["Apartment\n3 bedrooms, rent $450/month, deposit $900", "rent $1 per month; rent $2 per month\nfridge, 2 baths, hot water", None]
    got = rows(spark, texts, policy.grounded_facts(model, F.col("t"), form, list(policy.AMENITIES)))
    assert tuple(got[0]) == ("Lovely 3 bedrooms apartment", "Quiet. Enjoy. Pool .", 450.0, "USD", 3, None, "Apartment", "apartment", 900.0, [])
    assert tuple(got[1]) == ("Lovely 4 bedrooms house", "Quiet. It has 2 bathrooms. Enjoy hot water. Pool (2 baths).", None, None, 4, 2, "Private House", "house", None, ["refrigerator"])
    assert tuple(got[2])[2:6] == (999.0, "USD", 4, None)
    assert rows(spark, ["x"], policy.grounded_facts(F.when(F.lit(False), model), F.col("t"), form, []))[0] is None


def test_merged(spark):
    rest = "deposit double, min_lease int, has_pool boolean, electricity string, water string, cleaning string, pet_friendly boolean, amenities array<string>"
    own = "id int, title string, description string, price double, currency string, category string, city string, location string, property_type string, bedrooms int, bathrooms int, " + rest + ", _m string"
    blank = (None,) * 7
    listing = lambda i: (i, "t", "d", 100.0, "USD", "room", "a", None, None, 1, 1, *blank, ["pool"], "kept")
    told = "id int, is_real_estate boolean, admission_reason string, rejection_reason string, title string, description string, price double, currency string, category string, location string, property_type string, bedrooms int, bathrooms int, " + rest + ", has_facts boolean"
    answer = lambda i, real=True, category=None, text="fine", price=None, currency=None, facts=False: (i, real, None, None, " T ", text, price, currency, category, "b street", "Condo", 2, None, *blank, [], facts)
    answers = [answer(1), answer(2, facts=True), answer(3, facts=True, price=5.0, currency="KHR"), answer(4, real=False), answer(5, category="land"), answer(6, text="ភាសាខ្មែរ fine"), answer(7, real=None)]
    df = spark.createDataFrame([listing(i) for i in (1, 2, 3, 4, 5, 6, 7, 8, None)], own).drop("_m").withColumn("x.y", F.lit(1))
    out = enrichment.merged(df, spark.createDataFrame(answers, told), lambda place: F.when(place == "b street", "b"))
    got = {r["id"]: (r["outcome"], r["review_status"], r["review_reason"], r["title"], r["price"], r["currency"], r["category"], r["city"], r["bedrooms"], r["bathrooms"], r["amenities"], r["x.y"]) for r in out.collect()}
    same = ("t", 100.0, "USD", "room", "a", 1, 1, ["pool"], 1)
    unsure = ("T", 100.0, "USD", "apartment", "b", 2, 1, ["pool"], 1)
    assert got == {
        1: ("merged", "approved", None, *unsure), 2: ("merged", "pending", "monthly rent or currency unknown", "T", None, None, "apartment", "b", 2, None, ["pool"], 1),
        3: ("merged", "approved", None, "T", 5.0, "KHR", "apartment", "b", 2, None, ["pool"], 1), 4: ("rejected", "pending", "rejected as not housing", *same),
        5: ("rejected", "pending", "land is not supported", *same), 6: ("untranslated", "pending", "translation of low quality", *same),
        7: ("merged", "pending", "admission missing or uncertain", *unsure), 8: ("unread", "pending", "model's answer unavailable", *same), None: ("unread", "pending", "model's answer unavailable", *same),
    }
