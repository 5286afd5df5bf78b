"""Contacts over texts that customers' columns give, and clients' whole records of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.functions import contacts
from fieldmill.operators import client
from fieldmill.plans.catalogue import query
from fieldmill.sources.readers import table

NUMBERS = "SELECT *, c_custkey % 8 AS k, '0' || (10 + c_custkey % 80) || ' ' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 3, '0') AS a, '0' || (10 + c_nationkey) || ' 555 ' || lpad(CAST(c_custkey % 9000 AS VARCHAR), 4, '0') AS b FROM customer"


def _numbers():
    """Two numbers of a customer: of nine and of ten digits."""
    k = F.col("c_custkey")
    text = lambda c, n: F.lpad(c.cast("string"), n, "0")
    a = F.concat(F.lit("0"), (10 + k % 80).cast("string"), F.lit(" "), text(k % 1000, 3), F.lit(" "), text(k * 7 % 1000, 3))
    return a, F.concat(F.lit("0"), (10 + F.col("c_nationkey")).cast("string"), F.lit(" 555 "), text(k % 9000, 4))


@query(f"""SELECT c_custkey AS id, CASE k WHEN 0 THEN a WHEN 1 THEN a || ' / ' || b WHEN 2 THEN b WHEN 3 THEN a WHEN 4 THEN a WHEN 5 THEN b END AS phone,
 CASE k WHEN 0 THEN b WHEN 2 THEN a WHEN 3 THEN '@' || lower(c_mktsegment) || '_' || c_custkey WHEN 4 THEN a WHEN 6 THEN '@' || lower(c_mktsegment) || '_' || c_custkey ELSE '@seed' END AS telegram, CASE k WHEN 5 THEN a END AS whatsapp FROM ({NUMBERS})""")
def customer_contacts(spark, d):
    """Contacts by role: calls and chats in lines and in items, numbers without a label, suffixes, handles, links, none."""
    k, (a, b) = F.col("c_custkey") % 8, _numbers()
    lit, name = F.lit, F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey").cast("string"))
    texts = [
        F.concat(lit("Call: "), a, lit("\nTelegram: "), b), F.concat(lit("quiet house "), a, lit(" | "), b), F.concat(lit("Smart: "), b, lit(" (Call) / Cellcard: "), a, lit(" (Telegram)")),
        F.concat(lit("Contact "), a, lit(", telegram: @"), name), F.concat(lit("phone "), a, lit(" tg")), F.concat(lit("WhatsApp "), a, lit("\n"), b, lit("\n"), a),
        F.concat(lit("write to https://t.me/"), name), F.concat(lit("ask "), F.col("c_mktsegment")),
    ]
    t = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(texts)])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), contacts.contact_roles(t, telegram=lit("@seed")).alias("r")).select("id", "r.*")


@query(f"SELECT c_custkey AS id, a AS domestic, '+855 ' || a[2:] || ' / +855 ' || b[2:] AS international, a || ' (+855 ' || a[2:] || ')' AS both FROM ({NUMBERS})")
def customer_phone_forms(spark, d):
    a, b = _numbers()
    written = F.concat(F.lit("+855"), F.regexp_replace(F.substring(a, 2, 20), " ", "-"))
    form = contacts.formatted
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), form(written).alias("domestic"), form(F.concat(a, F.lit(", "), b), "international").alias("international"), form(a, "both").alias("both"))


@query("""SELECT p_partkey AS id, p_name AS description, 'Condo' AS property_type, CAST(round(p_size * 37 / 100.0) AS BIGINT) AS price_usd, CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS DOUBLE) END AS months,
 CASE WHEN p_partkey % 3 = 0 THEN 'Wi-Fi' ELSE 'Swimming Pool,Wi-Fi' END AS amenities, 'https://www.facebook.com/' || p_partkey AS original_url, CASE WHEN p_partkey % 2 = 0 THEN '012 345 678 / 096 123 4567' ELSE '+1 555 123 4567' END AS phone,
 CASE p_partkey % 4 WHEN 0 THEN '@name' WHEN 1 THEN '+inv1te' WHEN 2 THEN '012 345 678' ELSE 'by mail' END AS telegram, 'https://wa.me/85512' || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS whatsapp_link,
 EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS favorite, p_size AS bedrooms FROM part""")
def client_records(spark, d):
    """Parts as clients' whole records; those of large lines of orders are favorites."""
    k, none, key = F.col("p_partkey"), F.lit(None).cast("string"), F.col("p_partkey").cast("string")
    blank = {x: none for x in client.STORED}
    stored = blank | {"description": F.col("p_name"), "category": F.lit("apartment"), "bedrooms": F.col("p_size"), "has_pool": k % 3 == 0, "city": F.lit("Riverton")}
    own = {
        "id": k, "title": F.col("p_name"), "price": F.col("p_size") * 37, "deposit": F.lit(None).cast("long"), "property_type": F.lit("Condo"), "electricity": none, "water": none, "cleaning": none, "restrictions": F.array().cast("array<string>"), "lat": none, "lng": none,
        "photos": F.lit(None).cast("array<string>"), "phone": F.when(k % 2 == 0, "+85512345678, 096 123 4567").otherwise("+1 555 123 4567"), "whatsapp": F.concat(F.lit("012"), F.lpad((k % 1000000).cast("string"), 6, "0")),
        "chat": F.when(k % 4 == 0, "@name").when(k % 4 == 1, "https://t.me/+inv1te").when(k % 4 == 2, "+855 12 345 678").otherwise("by mail"),
        "facts": F.when(k % 4 == 0, '{"deposit_months":"2"}').when(k % 4 == 1, F.concat(F.lit('{"deposit_months":'), F.col("p_size").cast("string"), F.lit("}"))).when(k % 4 == 2, '{"deposit_months":121}').otherwise("{broken"),
        "amenities": F.array(F.lit("swimming_pool"), F.lit("WIFI"), F.lit("moon"), F.lit("wifi")), "warnings": F.lit(None).cast("array<string>"), "original_url": F.concat(F.lit("https://web.facebook.com/"), key),
    }
    rows = table(spark, d, "part").select(*[v.alias(n) for n, v in (stored | own).items()])
    liked = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    out = client.client_records(rows, {"swimming_pool": "Swimming Pool", "wifi": "Wi-Fi"}, liked)
    return out.select("id", "description", "property_type", "price_usd", F.col("deposit_months").alias("months"), F.array_join("amenities", ",").alias("amenities"), "original_url", "contact.phone", "contact.telegram", "contact.whatsapp_link", "favorite", "bedrooms")
