"""Queries over adverts: their wording, places, matching and upkeep. Registered beside the others in the catalogue."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.functions import adverts, media
from fieldmill.operators import matching, monitor, shaping, tiers
from fieldmill.plans.catalogue import FILTERS, LISTINGS, _filters, listings, query
from fieldmill.sources.readers import table


def _pick(by: str, *phrases: str) -> str:
    """One of the phrases for a number; the same text is SQL of either engine."""
    return f"CASE {by} % {len(phrases)} " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(phrases)) + " END"


BODY = "concat(" + ", ' ', ".join([
    _pick("p_partkey", "Nice apartment for rent", "Private house to rent", "Studio condo for sale", "Hotel room monthly", "Single room", "Shop house selling now", "Villa rental"),
    _pick("p_partkey", "in riverton", "location: oakdale", "near the market", "in oakdale", "at the old bridge"),
    _pick("p_partkey", "2 months deposit", "deposit: 1 month", "security deposit is $500", "no fees", "deposit 14 months", "deposit $1,200"),
    _pick("p_partkey", "min lease 6 months", "1 year contract", "month to month", "", "lease term: 2 years", "12 months lease", "", ""),
    _pick("p_partkey", "no pets", "no smoking and no parties", "pets are not allowed", "", "no cooking", "cannot sublease", "", "quiet hours", "all fine"),
    _pick("p_partkey", "available now", "already rented", "not rented yet", "no longer available", "", "", "", "", "", "", ""),
    _pick("p_partkey", "2 bedrooms 1 bath", "laptop for cheap", "free delivery of a blender", "", "massage and perm", "per night", "iphone and camera", "", "monthly", "per month", "", "", ""),
    _pick("p_partkey", "code: AB-1234", "Property ID 5678", "SR-0099a", "listing code = zx 12", "", "", "", ""),
]) + ")"
ADS = f"SELECT p_partkey AS id, {BODY} AS body, p_type AS title, CAST(round(p_retailprice * 100) AS BIGINT) AS rent FROM part"


def ads(spark: SparkSession, d: str) -> DataFrame:
    return shaping.spread(table(spark, d, "part")).selectExpr("p_partkey AS id", f"{BODY} AS body", "p_type AS title", "CAST(round(p_retailprice * 100) AS BIGINT) AS rent")


def _says(c: str, p: str) -> str:
    return f"regexp_matches({c}, '(?i){p.replace(chr(39), chr(39) * 2)}')"


def _found(c: str, patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '(?i){p}', 1), '')" for p in patterns) + ", NULL)"


def _ladder(c: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_says(c, p)} THEN '{n}'" for n, p in rules) + " END"


@query(f"""WITH a AS ({ADS}), x AS (SELECT id, body, rent, try_cast({_found('body', adverts.DEPOSIT_MONTHS)} AS BIGINT) AS m, try_cast(replace({_found('body', adverts.DEPOSIT_DOLLARS)}, ',', '') AS BIGINT) AS d,
 try_cast({_found('body', adverts.LEASE_YEARS)} AS BIGINT) AS ly, try_cast({_found('body', adverts.LEASE_MONTHS)} AS BIGINT) AS lm FROM a)
SELECT id, CASE WHEN m BETWEEN 1 AND 12 AND rent > 0 THEN rent * m WHEN d > 0 THEN d * 100 END AS deposit, CASE WHEN ly BETWEEN 1 AND 10 THEN ly * 12 WHEN lm BETWEEN 1 AND 60 THEN lm WHEN {_says('body', adverts.LEASE_MONTHLY)} THEN 1 END AS lease FROM x""")
def advert_terms(spark, d):
    return ads(spark, d).select("id", adverts.deposit_cents(F.col("body"), F.col("rent")).alias("deposit"), adverts.min_lease_months(F.col("body")).alias("lease"))


# What the phrases of BODY mean is stated by hand, not by the patterns under test.
@query("""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'apartment' WHEN 1 THEN 'house' WHEN 2 THEN 'apartment' WHEN 3 THEN 'hotel' WHEN 4 THEN 'room' ELSE 'house' END AS category,
 CASE WHEN p_partkey % 7 IN (2, 5) THEN 'sale' WHEN p_partkey % 7 IN (0, 1, 6) OR p_partkey % 8 IN (0, 4, 5) THEN 'rent' END AS offer,
 CASE p_partkey % 7 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'Private House' WHEN 2 THEN 'Studio' WHEN 3 THEN 'Hotel Room' WHEN 4 THEN 'Room' WHEN 5 THEN 'Flat House' ELSE 'Private Villa' END AS kind FROM part""")
def advert_kinds(spark, d):
    rows = ads(spark, d).withColumn("category", adverts.category(F.col("body")))
    return rows.select("id", "category", adverts.offer_type(F.col("body")).alias("offer"), adverts.property_type(F.col("body"), F.col("category")).alias("kind"))


@query("SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'no_pets' WHEN 1 THEN 'no_smoking,quiet' WHEN 2 THEN 'no_pets' WHEN 4 THEN 'no_cooking' WHEN 5 THEN 'no_sublease' WHEN 7 THEN 'quiet' ELSE '' END AS rules FROM part")
def advert_restrictions(spark, d):
    return ads(spark, d).select("id", F.array_join(adverts.restrictions(F.col("body")), ",").alias("rules"))


@query("""SELECT p_partkey AS id, CAST(CASE p_partkey % 13 WHEN 0 THEN -1 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 8 ELSE 0 END
 - CASE WHEN p_partkey % 13 IN (8, 9) OR p_partkey % 8 IN (0, 4, 5) OR p_partkey % 7 = 3 THEN 2 ELSE 0 END AS INTEGER) AS score FROM part""")
def advert_spam(spark, d):
    return ads(spark, d).select("id", adverts.spam_score(F.col("title"), F.col("body")).alias("score"))


@query(f"""WITH a AS ({ADS}) SELECT id, CASE WHEN {_says('body', adverts.GONE)} OR ({_says('body', adverts.LET)} AND NOT {_says('body', adverts.NOT_LET)}) THEN 'unavailable' WHEN {_says('body', adverts.FREE)} THEN 'available' END AS status,
 regexp_replace(lower({_found('body', adverts.CODES)}), '[\\s\\-–—]', '', 'g') AS code FROM a""")
def advert_status(spark, d):
    return ads(spark, d).select("id", adverts.availability(F.col("body")).alias("status"), adverts.property_code(F.col("body")).alias("code"))


HTML = "CASE p_partkey % 5 WHEN 0 THEN concat('<script type=\"application/ld+json\">{\"@type\":\"Product\",\"sku\":\"', CAST(p_partkey AS STRING), '\"}</script>') WHEN 1 THEN 'This listing was removed' WHEN 2 THEN '<title>Just a moment</title>' WHEN 3 THEN '<script type=\"application/ld+json\">{\"@type\":\"Product\",\"sku\":\"x\"}</script>' ELSE concat('<script id=\"__NUXT_DATA__\">[{\"id\":1,\"posted_date\":2,\"status\":3,\"available\":4},\"', CAST(p_partkey AS STRING), '\",\"2024-01-01\",\"active\",1]</script>') END"


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'alive' WHEN 1 THEN 'dead' WHEN 4 THEN 'alive' ELSE 'unknown' END AS state FROM part")
def page_liveness(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", f"{HTML} AS html")
    return rows.select("id", adverts.liveness(F.col("html"), F.col("id").cast("string")).alias("state"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) AS a, trim(regexp_replace(lead(text) OVER (PARTITION BY source, lang ORDER BY doc_id), '[ \t\r\n\f]+', ' ', 'g')) AS b FROM documents),
 w AS (SELECT *, list_distinct(string_split(lower(a), ' ')) AS wa, list_distinct(string_split(lower(b), ' ')) AS wb FROM t WHERE b IS NOT NULL)
 SELECT doc_id, CASE WHEN a = '' OR b = '' THEN b <> '' AND a <> b WHEN a = b THEN false ELSE abs(length(a) - length(b)) / greatest(length(a), 1) > 0.2 OR len(list_intersect(wa, wb)) / greatest(len(wa), 1) < 0.8 END AS changed FROM w""")
def text_change(spark, d):
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    rows = table(spark, d, "documents").withColumn("next", F.lead("text").over(w)).where("next IS NOT NULL")
    return rows.select("doc_id", adverts.text_changed(F.col("text"), F.col("next")).alias("changed"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS media FROM pages")
def media_identity(spark, d):
    return table(spark, d, "pages").select("page_id", media.identity(F.col("url")).alias("media"))


SIDES = "SELECT c_custkey AS id, 'l' AS side, 'n' || c_nationkey || CASE WHEN c_custkey % 50 = 0 THEN 'rare' ELSE '' END AS signal FROM customer UNION ALL SELECT s_suppkey + 1000000, 'r', 'n' || s_nationkey || CASE WHEN s_suppkey % 10 = 0 THEN 'rare' ELSE '' END FROM supplier"


@query(f"""WITH s AS ({SIDES}), c AS (SELECT signal, count(*) FILTER (WHERE side = 'l') AS nl, count(*) FILTER (WHERE side = 'r') AS nr, min(id) FILTER (WHERE side = 'l') AS a0, min(id) FILTER (WHERE side = 'r') AS b0 FROM s GROUP BY signal)
 SELECT a.id AS a, b.id AS b, count(*) AS signals FROM s a JOIN s b ON a.signal = b.signal AND a.side = 'l' AND b.side = 'r' JOIN c ON c.signal = a.signal WHERE nl * nr <= 64 OR a.id = a0 OR b.id = b0 GROUP BY ALL""")
def cross_source_pairs(spark, d):
    k = lambda key, nation, n, shift: ((F.col(key) + shift).alias("id"), F.concat(F.lit("n"), F.col(nation), F.when(F.col(key) % n == 0, "rare").otherwise("")).alias("signal"))
    left = table(spark, d, "customer").select(*k("c_custkey", "c_nationkey", 50, 0), F.lit("l").alias("side"))
    return matching.cross_pairs(left.unionByName(table(spark, d, "supplier").select(*k("s_suppkey", "s_nationkey", 10, 1000000), F.lit("r").alias("side"))))


@query("""SELECT l_orderkey AS o, l_linenumber AS n, round(least(1.0, least(1.0, CASE WHEN l_orderkey % 2 = 0 THEN 0.6 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 0.6 ELSE 0 END) + least(0.35, CASE WHEN l_suppkey % 5 = 0 THEN 0.25 ELSE 0 END) + least(0.25, CASE WHEN l_quantity > 25 THEN 0.08 ELSE 0 END)), 4) AS prop,
 round(least(1.0, least(1.0, CASE WHEN l_orderkey % 2 = 0 THEN 0.5 ELSE 0 END + CASE WHEN l_partkey % 3 = 0 THEN 0.35 ELSE 0 END) + least(0.45, CASE WHEN l_quantity > 25 THEN 0.08 ELSE 0 END)), 4) AS listing FROM lineitem""")
def pair_evidence(spark, d):
    c = F.col
    s = matching.evidence_scores({"same_code": c("l_orderkey") % 2 == 0, "same_map": c("l_partkey") % 3 == 0, "same_phone": c("l_suppkey") % 5 == 0, "same_beds": c("l_quantity") > 25})
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("o"), c("l_linenumber").alias("n"), s["property"].alias("prop"), s["listing"].alias("listing"))


@query("SELECT l_orderkey AS item, l_linenumber AS pick, method FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN method = 'hash' THEN 0 ELSE 1 END, l_linenumber) AS r FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'hash' WHEN l_quantity * 2 >= 75 THEN 'score' END AS method FROM lineitem) WHERE method IS NOT NULL) WHERE r = 1")
def first_duplicates(spark, d):
    rows = matching.first_duplicate(table(spark, d, "lineitem"), "l_orderkey", F.col("l_linenumber"), F.col("l_returnflag") == "R", F.col("l_quantity") * 2)
    return rows.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("pick"), "method")


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY n_chars) AS property, min(doc_id) OVER (PARTITION BY text) AS listing FROM documents")
def two_level_components(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"), "n_chars")
    stars = lambda c, kind: shaping.star_pairs(rows.select("id", F.col(c).alias("signal"))).withColumn("decision", F.lit(kind))
    return matching.two_levels(rows, stars("h", "SAME_LISTING").unionByName(stars("n_chars", "SAME_PROPERTY")))


@query("SELECT doc_id AS id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 97 = 0)")
def recluster_scope(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("signal"))
    return matching.affected_closure(rows, rows.where("id % 97 = 0"))


@query("SELECT a.p_partkey AS id, CASE WHEN b.price > 0 AND (coalesce(a.price, 0) <= 0 OR b.price < a.price) THEN b.price ELSE a.price END AS price, coalesce(a.brand, b.brand) AS brand FROM (SELECT p_partkey, nullif(p_size % 4, 0) AS price, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand FROM part) a JOIN (SELECT p_partkey, p_size % 5 AS price, p_brand AS brand FROM part) b USING (p_partkey)")
def duplicate_merge(spark, d):
    p = table(spark, d, "part")
    a = {"price": F.nullif(F.col("p_size") % 4, F.lit(0)), "brand": F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_brand"))}
    return p.select(F.col("p_partkey").alias("id"), *matching.merged(a, {"price": F.col("p_size") % 5, "brand": F.col("p_brand")}))


@query("SELECT count(*) FILTER (WHERE s) AS positives, count(*) FILTER (WHERE s AND m) AS recalled, count(*) FILTER (WHERE NOT s AND m) AS false_merges FROM (SELECT o_orderkey % 3 = 0 AS s, o_orderkey % 5 > 0 AND o_custkey % 4 < 2 AS m FROM orders)")
def golden_pair_report(spark, d):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(a.alias("a"), b.alias("b"), F.when(a % 3 == 0, "SAME").otherwise("DIFFERENT").alias("label"), F.when(b % 4 < 2, "SAME_LISTING").otherwise("DIFFERENT").alias("decision"))
    return matching.golden_pairs(rows.where("a % 5 > 0").select("a", "b", "decision"), rows.select("a", "b", "label"))


def _any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


@query(f"WITH a AS ({ADS}) SELECT id, CASE WHEN id % 4 = 0 AND id % 9 <> 0 THEN 'EXACT' WHEN id % 4 = 0 THEN 'PROBABLE' WHEN id % 4 = 1 OR {_any('body', tiers.RENT_WORDS)} THEN 'PROBABLE' ELSE 'UNKNOWN' END AS tier FROM a")
def offer_tier_language(spark, d):
    k = F.col("id")
    offer, price = F.when(k % 4 == 0, "rent").when(k % 4 == 1, "mixed"), F.when(k % 9 != 0, F.col("rent"))
    return ads(spark, d).select("id", tiers.offer_tier(offer, F.col("body"), price).alias("tier"))


FIELD = "CASE WHEN id % 10 = 0 THEN 'Oakdale centre' WHEN id % 10 = 1 THEN 'Riverton' ELSE '' END"


@query(f"""WITH a AS ({ADS}), f AS (SELECT *, {FIELD} AS field, CASE WHEN id % 3 = 0 THEN 'oakdale' ELSE 'other' END AS src FROM a)
 SELECT id, CASE WHEN contains(lower(field), 'oakdale') OR {_any('body', ('in oakdale', 'location: oakdale'))} THEN 'EXACT_CITY' WHEN src = 'oakdale' OR contains(lower(body), 'old bridge') THEN 'PROBABLE_CITY' ELSE 'UNKNOWN_CITY' END AS tier,
 CASE WHEN src = 'oakdale' AND NOT {_any("concat_ws(' ', field, body)", ('oakdale', 'old bridge'))} THEN 'SOURCE_PRIOR_ONLY' ELSE 'LOCAL_EVIDENCE' END AS evidence,
 contains(lower(field), 'riverton') OR ({_any('body', ('in riverton', 'location: riverton', 'riverton, cambodia'))} AND NOT contains(lower(field), 'oakdale')) AS outside FROM f""")
def city_tiers(spark, d):
    rows = ads(spark, d).withColumn("field", F.expr(FIELD)).withColumn("src", F.when(F.col("id") % 3 == 0, "oakdale").otherwise("other"))
    c, local = F.col, ("old bridge",)
    return rows.select("id", tiers.city_tier(c("field"), c("body"), c("src"), "oakdale", local).alias("tier"), tiers.city_evidence(c("field"), c("body"), c("src"), "oakdale", local).alias("evidence"), tiers.out_of_area(c("field"), F.lit(""), c("title"), c("body"), "oakdale", ("riverton",)).alias("outside"))


@query(f"""WITH a AS ({ADS}), x AS (SELECT id, {_any('body', ('in riverton', 'location: riverton'))} AS said, {_any('body', ('riverton',))} AS named, {_any('body', ('oakdale',))} AS home, {_any('body', ('old bridge',))} AS area FROM a)
 SELECT tier, count(*) AS n FROM (SELECT CASE WHEN said AND NOT home AND NOT area THEN 'CONTRADICTION_CITY' WHEN said OR named THEN 'GEOGRAPHY_CONFLICT' WHEN home THEN 'EXACT_CITY' WHEN area OR id % 2 = 0 THEN 'PROBABLE_CITY' ELSE 'UNKNOWN_CITY' END AS tier FROM x) GROUP BY tier""")
def geography_tiers(spark, d):
    src = F.when(F.col("id") % 2 == 0, "oakdale").otherwise("")
    return ads(spark, d).groupBy(tiers.geography_tier(F.col("body"), F.lit(""), src, ("oakdale",), ("old bridge",), ("riverton",)).alias("tier")).agg(F.count("*").alias("n"))


@query(LISTINGS + ", " + FILTERS + """ SELECT id, filter_id FROM listings JOIN filters ON category = 'Brand#' || (11 + filter_id % 5) AND (bedrooms IS NULL OR bedrooms = rooms OR (rooms = 4 AND bedrooms >= 4)) AND price >= low AND price <= high
 AND (min_lease IS NULL OR (filter_id % 3 = 0 AND min_lease <= 5) OR (filter_id % 3 = 1 AND min_lease >= 6) OR filter_id % 3 = 2)""")
def saved_search_matches(spark, d):
    s = _filters(spark, d).select("filter_id", F.concat(F.lit("Brand#"), 11 + F.col("filter_id") % 5).alias("kind"), F.col("low"), F.col("high"), F.array("rooms").alias("bedrooms"), F.when(F.col("filter_id") % 3 == 0, 5).when(F.col("filter_id") % 3 == 1, 6).alias("lease"))
    # Filters that ask for the same match the same rows, which are found once.
    asked = ["kind", "low", "high", "bedrooms", "lease"]
    rows, kinds, c = shaping.spread(listings(spark, d), "id").alias("p"), s.select(*asked).distinct().alias("s"), F.col
    none, yes, places = F.lit(None).cast("string"), F.lit(False), F.array().cast("array<string>")
    fits = tiers.matches_search(
        {"kind": c("p.category"), "city": F.lit("x"), "category": none, "pool": yes, "min_lease": c("p.min_lease"), "bedrooms": c("p.bedrooms"), "place": F.lit(""), "price": c("p.price")},
        {"kind": c("s.kind"), "city": F.lit("x"), "category": none, "pool": yes, "lease": c("s.lease"), "bedrooms": c("s.bedrooms"), "places": places, "low": c("s.low") / 100, "high": c("s.high") / 100},
    )
    found = rows.join(kinds, (c("p.category") == c("s.kind")) & fits).select("id", *[c(f"s.{x}").alias(f"_{x}") for x in asked])
    return found.join(s, reduce(and_, [c(x).eqNullSafe(c(f"_{x}")) for x in asked])).select("id", "filter_id")


@query(LISTINGS + "SELECT CASE WHEN price IS NULL THEN 'no_price' WHEN price <= 0 THEN 'free' WHEN bedrooms IS NULL THEN 'no_rooms' ELSE 'shown' END AS reason, count(*) AS n FROM listings GROUP BY 1")
def exclusion_funnel(spark, d):
    c = F.col
    return tiers.exclusion_funnel(listings(spark, d), [("no_price", c("price").isNull()), ("free", c("price") <= 0), ("no_rooms", c("bedrooms").isNull())])


@query("WITH v AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 3 END AS p, p_partkey % 5 AS t, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 7 END AS a FROM part), r AS (SELECT *, coalesce(CASE WHEN p = t THEN p WHEN p = a THEN p WHEN t = a THEN t END, p, t, a) AS area FROM v) SELECT id, area, CAST(coalesce(CAST(p = area AS INT), 0) + coalesce(CAST(t = area AS INT), 0) + coalesce(CAST(a = area AS INT), 0) AS INT) AS support FROM r")
def location_votes(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), tiers.location_vote(F.when(k % 4 > 0, k % 3), k % 5, F.when(k % 2 == 0, k % 7)).alias("v")).select("id", "v.area", "v.support")


@query(LISTINGS + "SELECT id FROM listings WHERE 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lng) / 2), 2)))) <= 3000 AND NOT (lat BETWEEN 0 AND 5 AND lng BETWEEN 10 AND 30)")
def plausible_pins(spark, d):
    return listings(spark, d).where(tiers.plausible_pin(F.col("lat"), F.col("lng"), (10.0, 20.0), 3000, (0, 10, 5, 30))).select("id")


@query("SELECT s_suppkey AS id FROM supplier WHERE ((s_suppkey - 95) % 100 + 100) % 100 < 12")
def source_round_robin(spark, d):
    return monitor.round_robin(table(spark, d, "supplier"), "s_suppkey", 95, 12, 100).select(F.col("s_suppkey").alias("id"))


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE user_id % 3 = 0) ORDER BY ts, event_id LIMIT 40")
def unseen_posts(spark, d):
    e = table(spark, d, "events")
    return monitor.unseen(e, e.where("user_id % 3 = 0"), "event_id", [F.asc("ts"), F.asc("event_id")], 40).select("event_id")


@query("WITH l AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY user_id) SELECT user_id, CAST(least(14400.0, 300 * pow(2, count(*) FILTER (WHERE last IS NULL OR event_id > last))) AS BIGINT) AS interval FROM events JOIN l USING (user_id) GROUP BY user_id")
def visit_intervals(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("fresh"))
    return monitor.interval_fold(rows, "user_id", "event_id", "fresh")


@query("""WITH s AS (SELECT user_id % 20 AS listing, user_id AS source, CASE event_type WHEN 'view' THEN 'available' WHEN 'error' THEN 'unavailable' END AS signal, ts FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY listing, source ORDER BY ts DESC, signal) AS r FROM s WHERE signal IS NOT NULL),
 n AS (SELECT *, max(ts) OVER (PARTITION BY listing) AS now FROM f WHERE r = 1), o AS (SELECT listing, bool_or(signal = 'available') AS free, max(ts) FILTER (WHERE signal = 'available') AS a, max(ts) FILTER (WHERE signal <> 'available') AS u FROM n WHERE ts >= now - INTERVAL 30 DAY GROUP BY listing)
 SELECT listing, CASE WHEN free THEN 'available' ELSE 'rented' END AS status, CASE WHEN free THEN a ELSE u END AS confirmed_at FROM o""")
def availability_evidence(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("listing"), F.col("user_id").alias("source"), F.when(F.col("event_type") == "view", "available").when(F.col("event_type") == "error", "unavailable").alias("signal"), "ts")
    return monitor.availability_fold(rows, "listing", "source", "signal", "ts")


@query("SELECT event_id AS id, CAST(event_id % 7 + 1 AS BIGINT) AS token FROM events WHERE event_id % 7 < 5 AND ((event_id % 3 = 0 AND (event_id % 7 = 0 OR event_id + event_id % 7 * 300 <= 6000)) OR (event_id % 3 = 1 AND event_id - 50 < 6000))")
def claimable_jobs(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(k.alias("id"), F.when(k % 3 == 0, "queued").when(k % 3 == 1, "running").otherwise("done").alias("status"), (k - 50).alias("lease_until"), (k % 7).alias("attempts"), k.alias("updated_at"))
    return monitor.claimable(rows, F.lit(6000)).select("id", "token")


SAMPLES = "SELECT user_id % 10 AS g, CAST(floor(event_id / 2000) AS BIGINT) AS s, event_id % 700 AS post, event_id AS position, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events"


@query(f"""WITH r AS (SELECT g, s, post, min(position) AS position, max(t) AS t FROM ({SAMPLES}) GROUP BY ALL), x AS (SELECT r.*, min(s) OVER (PARTITION BY g, post) AS first, CASE WHEN t > lag(t) OVER (PARTITION BY g, s ORDER BY position) THEN 1 ELSE 0 END AS inv, EXISTS (SELECT 1 FROM r b WHERE b.g = r.g AND b.post = r.post AND b.s = r.s - 1) AS shared FROM r),
 o AS (SELECT g, s, count(*) AS posts, count(*) FILTER (WHERE first = s) AS fresh, CAST(sum(inv) AS BIGINT) AS inversions, count(*) FILTER (WHERE shared) AS sh, min(t) AS old, max(t) AS new FROM x GROUP BY ALL), p AS (SELECT *, row_number() OVER w AS k, max(new) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o WINDOW w AS (PARTITION BY g ORDER BY s))
 SELECT g, s, posts, fresh, inversions, posts >= 180 AS capped, CASE WHEN k = 1 THEN 'initial' WHEN inversions > 0 OR seen IS NULL THEN 'unknown' WHEN sh > 0 THEN 'overlap' WHEN old <= seen THEN 'timestamp_reach_unverified' ELSE 'possible_gap' END AS coverage, CASE WHEN posts >= 3 AND new > old THEN round((posts - 1) / ((new - old) / 3600.0), 4) END AS per_hour FROM p""")
def group_coverage(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select((F.col("user_id") % 10).alias("g"), F.floor(k / 2000).alias("s"), (k % 700).alias("post"), k.alias("position"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return monitor.group_activity(rows, "g", "s", "post", "t", 180)


@query("SELECT user_id, round(max(value * pow(0.8, age)), 4) AS rate FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age FROM events) GROUP BY user_id")
def decayed_rates(spark, d):
    return monitor.decayed_rate(table(spark, d, "events"), "user_id", "event_id", "value")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS was FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 5 = 0 OR o_orderstatus <> 'O')")
def approval_events(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return monitor.status_events(o.where("id % 5 > 0"), o.withColumn("status", F.when(F.col("id") % 2 == 0, "O").otherwise("F")), "id", "status", "O")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 4 > 0 AND doc_id % 6 > 0 THEN 'old' END AS class FROM documents")
def enrichment_gate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    state = docs.where("doc_id % 4 > 0").select("doc_id", "n_chars", F.when(F.col("doc_id") % 6 > 0, "old").alias("class"))
    results = monitor.to_enrich(docs, state.withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("n_chars"))), "doc_id", "n_chars").where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("class"))
    return monitor.enriched(docs, state, results, "doc_id").select("doc_id", "class")


@query("SELECT CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 3 = 0 THEN 'changed' WHEN p_partkey % 4 = 0 THEN 'price_synced' ELSE 'confirmed' END AS outcome, count(*) AS n FROM part GROUP BY 1")
def verification_sweep(spark, d):
    k = F.col("id")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("hash"))
    seen = p.where("id % 5 > 0").select("id", F.when(k % 7 == 0, "dead").otherwise("alive").alias("state"), F.when(k % 4 == 0, -1.0).otherwise(F.col("price")).alias("price"), F.when(k % 3 == 0, "").otherwise(F.col("hash")).alias("hash"))
    return monitor.sweep(p, seen, "id")


@query("SELECT c_custkey AS slug, count(e.event_id) FILTER (WHERE event_type = 'click') AS clicks, count(e.event_id) FILTER (WHERE event_type = 'view') AS opens FROM customer LEFT JOIN events e ON user_id = c_custkey GROUP BY 1")
def link_attribution(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("slug"), F.when(F.col("event_type") == "view", "open").otherwise(F.col("event_type")).alias("kind"))
    return monitor.attribution(table(spark, d, "customer").select(F.col("c_custkey").alias("slug")), e, "slug", "kind")


@query("WITH a AS (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(max(o_custkey) AS DOUBLE) AS top FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT CAST(count(*) AS DOUBLE) AS rows, CAST(max(o_custkey) AS DOUBLE) AS top FROM orders) SELECT 'rows' AS metric, a.rows AS before, b.rows AS after, b.rows - a.rows AS change FROM a, b UNION ALL SELECT 'top', a.top, b.top, b.top - a.top FROM a, b")
def snapshot_metrics(spark, d):
    o = table(spark, d, "orders")
    return monitor.before_after(o.where("o_orderkey % 3 = 0"), o, {"rows": F.count("*"), "top": F.max("o_custkey")})


@query(LISTINGS + ", c AS (SELECT count(price) AS p, count(bedrooms) AS b, count(*) FILTER (WHERE title <> '') AS t FROM listings) SELECT 'price' AS field, p AS filled FROM c UNION ALL SELECT 'bedrooms', b FROM c UNION ALL SELECT 'title', t FROM c")
def field_completeness(spark, d):
    return monitor.completeness(listings(spark, d), ["price", "bedrooms", "title"])


@query("SELECT source, count(*) AS posts, count(*) FILTER (WHERE lang = 'en') AS en, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 2) AS en_per_100, count(*) FILTER (WHERE doc_id = f) AS credited, round(100.0 * count(*) FILTER (WHERE doc_id <> f) / count(*), 2) AS duplicate_rate FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) GROUP BY source")
def source_report(spark, d):
    rows = table(spark, d, "documents").select("source", "lang", "doc_id", F.sha2("text", 256).alias("h"))
    return monitor.source_report(rows, "source", "lang", ["en"], "h", "doc_id")


@query("WITH c AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM c)) SELECT 'customer' AS \"table\", id FROM c UNION ALL SELECT 'orders', id FROM o UNION ALL SELECT 'lineitem', id FROM (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM o))")
def cascade_closure(spark, d):
    t = lambda n: table(spark, d, n)
    return monitor.cascade(t("nation").where("n_nationkey = 3"), "n_nationkey", [("customer", t("customer"), "c_custkey", "c_nationkey"), ("orders", t("orders"), "o_orderkey", "o_custkey"), ("lineitem", t("lineitem"), "l_partkey", "l_orderkey")])


@query("WITH g AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN g.id IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS problem FROM g FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) ON g.id = c_custkey) SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY problem")
def answer_contract(spark, d):
    asked = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"))
    return monitor.batch_contract(asked, table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id")))


@query("SELECT p_partkey AS id FROM part ORDER BY sha256('seed' || p_partkey) LIMIT 25")
def hashed_sample(spark, d):
    return monitor.hashed_sample(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", "seed", 25)


@query(LISTINGS + """SELECT * FROM (SELECT true AS exact, CAST(id AS VARCHAR) AS key, CAST(1 AS BIGINT) AS n, price AS low, price AS high FROM listings WHERE bedrooms IS NOT NULL AND lat BETWEEN -10 AND 10 ORDER BY id LIMIT 300)
 UNION ALL SELECT false, category, count(*), min(price), max(price) FROM listings WHERE bedrooms IS NULL GROUP BY category""")
def map_view(spark, d):
    return monitor.map_view(listings(spark, d), F.col("lat").between(-10, 10), F.col("bedrooms").isNotNull(), F.col("category"))


@query("SELECT doc_id, len(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS words, CAST(CASE WHEN text = '' THEN 0 ELSE len(list_distinct(string_split(lower(text), ' '))) END AS BIGINT) AS tokens FROM documents")
def text_sizes(spark, d):
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.when(F.col("text") == "", 0).otherwise(F.size(F.array_distinct(F.split(F.lower("text"), " ")))).cast("long").alias("tokens"))
