"""Counts of rooms, the policy on a model's facts and the merge into listings, over texts and facts that the tables' columns give."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.functions import policy, rooms
from fieldmill.operators import enrichment
from fieldmill.operators.shaping import spread
from fieldmill.plans.catalogue import query
from fieldmill.sources.readers import table


def _joined(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _by_key(k, n: int, texts: list):
    return F.coalesce(*[F.when(k % n == i, t) for i, t in enumerate(texts)])


@query("""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 3 THEN NULL WHEN 5 THEN n + m WHEN 6 THEN CASE WHEN n = m THEN n END WHEN 7 THEN 0 ELSE n END AS bedrooms,
 CASE WHEN p_partkey % 8 IN (0, 1, 2, 4) THEN m END AS bathrooms, p_partkey % 8 = 3 OR (p_partkey % 8 = 6 AND n <> m) AS bedrooms_conflict, false AS bathrooms_conflict
 FROM (SELECT *, p_size % 13 + 1 AS n, p_size % 4 + 1 AS m FROM part)""")
def part_room_fields(spark, d):
    """Rooms of adverts in eight layouts: floor plans, labels before and behind, sums, components, compounds, contradictions, studios."""
    k, n, m = F.col("p_partkey"), F.col("p_size") % 13 + 1, F.col("p_size") % 4 + 1
    t = _by_key(k, 8, [
        _joined(n, "-Bedroom House\nLayout: ", n, " Bed | ", m, " Bath"), _joined("Bedroom ", n, " Bathroom ", m), _joined("for rent $450 ", n, " bedrooms ", m, " bathrooms"),
        _joined("Bedrooms: ", n, " + 1"), _joined(n, " Bedrooms, ", m, " Bathrooms\n6-Unit Rooms: 1-Bed, 1-Bath each"),
        _joined(n + m, " Bedrooms\nMain ", n, "-Bedroom Villa\nBungalows: ", m, " additional Bedrooms"), _joined(n, " Bedrooms\nBedrooms: ", m), _joined("Studio with ", n, " beds"),
    ])
    return table(spark, d, "part").select(k.alias("id"), rooms.room_counts(_joined(F.col("p_name"), "\n", t)).alias("r")).select("id", "r.*")


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN own WHEN 1 THEN NULL WHEN 4 THEN own ELSE price END AS price, CASE WHEN p_partkey % 5 = 1 THEN NULL WHEN p_partkey % 5 = 4 THEN 'KHR' ELSE 'USD' END AS currency,
 CASE p_partkey % 5 WHEN 0 THEN m WHEN 3 THEN CASE WHEN n = m THEN m END END AS bedrooms, CASE WHEN p_partkey % 5 = 2 THEN CAST(p_size * 10 AS DOUBLE) END AS deposit,
 CASE WHEN p_partkey % 5 = 0 THEN 'Apartment' ELSE 'Private House' END AS property_type, CASE WHEN p_partkey % 5 = 0 THEN 'apartment' ELSE 'house' END AS category,
 CASE WHEN p_partkey % 5 = 4 THEN ['refrigerator'] ELSE [] END AS amenities,
 CASE WHEN p_partkey % 5 = 0 THEN m || ' bedrooms apartment ' WHEN p_partkey % 5 = 3 AND n = m THEN n || ' bedrooms house ' ELSE 'house ' END || p_name AS title
 FROM (SELECT *, p_size % 5 + 1 AS n, p_size % 3 + 1 AS m, round(p_retailprice * 100) / 100 AS price, CAST(p_size * 1000 AS DOUBLE) AS own FROM part)""")
def part_fact_policy(spark, d):
    """A model's facts held against texts: confirmed and contradictory rents, deposits, a form's rooms, headings, amenities, claims in titles."""
    k, n, m, own = F.col("p_partkey"), F.col("p_size") % 5 + 1, F.col("p_size") % 3 + 1, F.format_number(F.col("p_size") * 1000, 0)
    t = _by_key(k, 5, [
        _joined("Apartment for rent\n", m, " bedrooms, rent: $", own, "/month"), _joined("Rent $", own, " per month; rent USD 7 per month"), _joined("Rent $", own, ". Deposit: $", F.col("p_size") * 10),
        _joined("quiet place"), _joined("Water price $3 per month. Monthly rent: ", own, " KHR. With a fridge"),
    ])
    model = F.struct(_joined(n, " bedrooms house ", F.col("p_name")).alias("title"), F.lit("").alias("description"), (F.round(F.col("p_retailprice") * 100) / 100).alias("price"), F.lit("USD").alias("currency"), n.alias("bedrooms"), F.lit(1).alias("bathrooms"), F.lit("Private House").alias("property_type"), F.lit("room").alias("category"), F.array(F.lit("refrigerator"), F.lit("moon")).alias("amenities"))
    form = F.struct(F.when(k % 5 == 3, m).alias("bedrooms"), F.lit(None).cast("int").alias("bathrooms"))
    facts = policy.grounded_facts(model, t, form, list(policy.AMENITIES))
    return spread(table(spark, d, "part")).select(k.alias("id"), facts.alias("f")).select("id", *[f"f.{c}" for c in ("price", "currency", "bedrooms", "deposit", "property_type", "category", "amenities", "title")])


@query("""WITH m AS (SELECT l_partkey AS id, count(*) AS n, CAST(max(l_quantity) AS INTEGER) AS beds, 'L' || max(l_linenumber) AS place FROM lineitem GROUP BY l_partkey HAVING count(*) % 5 > 0),
j AS (SELECT p_partkey, p_name, round(p_retailprice * 100) / 100 AS price, m.*, CASE WHEN m.id IS NULL THEN 'unread' WHEN n % 7 = 0 OR n % 11 = 0 THEN 'rejected' ELSE 'merged' END AS outcome, n % 3 = 0 AS sure FROM part LEFT JOIN m ON id = p_partkey)
SELECT p_partkey AS id, outcome, CASE WHEN outcome = 'merged' AND sure THEN CASE WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) END ELSE price END AS price,
 CASE WHEN outcome = 'merged' THEN CASE WHEN n % 13 = 0 AND NOT sure THEN 1 ELSE CASE WHEN n % 13 <> 0 THEN beds END END ELSE 1 END AS bedrooms,
 CASE WHEN outcome = 'merged' THEN 'apartment' ELSE 'room' END AS category, CASE WHEN outcome = 'merged' AND place = 'L7' THEN 'sky' ELSE 'town' END AS city,
 CASE WHEN outcome = 'merged' AND NOT (sure AND n % 2 = 1) THEN 'approved' ELSE 'pending' END AS review_status,
 CASE WHEN outcome = 'unread' THEN 'model''s answer unavailable' WHEN outcome = 'rejected' THEN CASE WHEN n % 11 = 0 THEN 'land is not supported' ELSE 'rejected as not housing' END WHEN sure AND n % 2 = 1 THEN 'monthly rent or currency unknown' END AS review_reason FROM j""")
def part_enriched(spark, d):
    """Parts as listings, and what their lines of orders say of them as a model's answers."""
    null = lambda kind: F.lit(None).cast(kind)
    n = F.col("n")
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_quantity").cast("int").alias("beds"), F.concat(F.lit("L"), F.max("l_linenumber").cast("string")).alias("place")).where("n % 5 > 0")
    rest = [null("double").alias("deposit"), null("int").alias("min_lease"), null("boolean").alias("has_pool"), *[null("string").alias(x) for x in ("electricity", "water", "cleaning")], null("boolean").alias("pet_friendly")]
    answers = lines.select(
        F.col("l_partkey").alias("id"), (n % 7 > 0).alias("is_real_estate"), null("string").alias("admission_reason"), null("string").alias("rejection_reason"), F.lit("flat").alias("title"), F.lit("a flat").alias("description"),
        F.when(n % 2 == 0, n.cast("double")).alias("price"), F.lit("USD").alias("currency"), F.when(n % 11 == 0, "land").alias("category"), F.col("place").alias("location"), F.lit("Studio").alias("property_type"),
        F.when(n % 13 > 0, F.col("beds")).alias("bedrooms"), null("int").alias("bathrooms"), *rest, null("array<string>").alias("amenities"), (n % 3 == 0).alias("has_facts"),
    )
    own = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), null("string").alias("description"), (F.round(F.col("p_retailprice") * 100) / 100).alias("price"), F.lit("USD").alias("currency"), F.lit("room").alias("category"),
        F.lit("town").alias("city"), F.lit(" ").alias("location"), null("string").alias("property_type"), F.lit(1).alias("bedrooms"), null("int").alias("bathrooms"), *rest, null("array<string>").alias("amenities"),
    )
    out = enrichment.merged(own, answers, lambda place: F.when(place == "L7", "sky"))
    return out.select("id", "outcome", "price", "bedrooms", "category", "city", "review_status", "review_reason")
