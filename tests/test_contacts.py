from pyspark.sql import functions as F

from fieldmill.functions import contacts

# text -> phone, telegram, whatsapp
CASES = {
    "Flat\n Tel: 012 345 678\n Telegram: 098 765 432\n WhatsApp: 098 765 432\n": ("012 345 678", "098 765 432", "098 765 432"),
    "Call: 012 345 678\nTelegram/WhatsApp: 098 765 432": ("012 345 678", None, "098 765 432"),  # the label behind the stroke starts an item
    "Villa $600/mo. Smart: 096 934 3456 (Call) / Cellcard: 012 888 999 (Telegram)": ("096 934 3456", "012 888 999", None),
    "Contact: 089 899 084, Telegram: @cambodia_realtor": ("089 899 084", "@cambodia_realtor", None),
    "ផ្ទះជួលស្អាត\n លេខទូរស័ព្ទ៖ 012 333 444\n តេឡេក្រាម៖ 097 555 6666": ("012 333 444", "097 555 6666", None),
    "Cozy studio $180/mo. 089 899 084": ("089 899 084", None, None),
    "+85512345678 | 0961234567": ("012 345 678 / 096 123 4567", None, None),
    "Telegram 012 345 678": (None, "012 345 678", None), "see https://t.me/some_one": (None, "@some_one", None), "mail a@gmail.com": (None, None, None),
    "tg: @first1\ntg: @second2": (None, "@second2", None), "012 345 678 and 098 765 432 (whatsapp)": (None, None, "012 345 678"),
    "call 012 345 678 tg": ("012 345 678", "012 345 678", None), "": (None, None, None), None: (None, None, None), "ref 112 345 678": (None, None, None),
}


def test_roles(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, t string")
    got = {r["i"]: tuple(r["r"]) for r in df.select("i", contacts.contact_roles(F.col("t")).alias("r")).collect()}
    assert [(t, got[i]) for i, t in enumerate(CASES)] == list(CASES.items())
    seeds = [F.lit("+855 12 345 678, 0961234567"), F.lit("@seed"), F.lit("w")]
    said = df.where("i IN (5, 13)").orderBy("i").select(contacts.contact_roles(F.col("t"), *seeds).alias("r")).collect()
    assert [tuple(r["r"]) for r in said] == [("089 899 084", "@seed", "w"), ("012 345 678 / 096 123 4567", "@seed", "w")]


def test_forms(spark):
    want = {"+855 12 345 678": ("012 345 678", "+855 12 345 678"), "0969343456": ("096 934 3456", "+855 96 934 3456"), "1234567": ("012 345 67", "+855 12 345 67"), "012345678901": ("012345678901", "+855 12345678901"), "12": (None, None), "012 345 678 / 12, 098765432": ("012 345 678 / 098 765 432", "+855 12 345 678 / +855 98 765 432")}
    df = spark.createDataFrame([(i, x) for i, x in enumerate(want)], "i int, t string")
    c = F.col("t")
    got = df.orderBy("i").select(contacts.formatted(c).alias("a"), contacts.formatted(c, "international").alias("b"), contacts.formatted(c, "both").alias("c")).collect()
    assert [(r["a"], r["b"]) for r in got] == list(want.values())
    assert got[0]["c"] == "012 345 678 (+855 12 345 678)" and got[4]["c"] == "12" and got[5]["c"].split(" / ")[1] == "12"
