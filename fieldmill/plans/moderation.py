"""Queries of publication's rules: a record that passes, changed in one place for each remainder of an identifier; the SQL states what holds it."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.operators import moderation
from fieldmill.plans.catalogue import QUERIES, SQL, query
from fieldmill.sources.readers import table

#: The record that passes, as SQL of Spark.
PASSES = {
    "status": "'active'", "availability": "'available'", "title": "'House'", "category": "'house'", "city": "'riverton'", "review_reason": "CAST(NULL AS STRING)", "default_hold": "false",
    "url": "'https://a.example/1'", "raw": "'House for rent, $450 a month'", "source_title": "CAST(NULL AS STRING)", "source": "'SITE'", "published": "TIMESTAMP '2024-02-20 00:00:00'", "first_seen": "CAST(NULL AS TIMESTAMP)",
    "bindings": "1", "url_conflicts": "0", "aliases": "0", "duplicates": "0", "city_exact": "true", "city_flags": "CAST(NULL AS ARRAY<STRING>)", "price": "450D", "stated_price": "450D", "offer_price": "CAST(NULL AS DOUBLE)",
    "monthly": "array(450D)", "asking": "CAST(array() AS ARRAY<DOUBLE>)", "payload_ok": "true", "rejected": "false", "payload_city": "'Riverton'", "payload_type": "'rent'", "group_rent": "false",
    "own_beds": "2", "source_beds": "2", "text_beds": "2", "own_baths": "1", "source_baths": "1", "text_baths": "1", "beds_conflict": "false", "baths_conflict": "false",
}
#: Changes to it, and the codes that they bring.
CASES = [
    ({}, ""), ({"review_reason": "'seen before'"}, "PRIOR_MANUAL_REVIEW_REASON"), ({"review_reason": "'by default'", "default_hold": "true"}, ""), ({"availability": "'rented'"}, "NOT_AVAILABLE"), ({"status": "'closed'"}, "NOT_AVAILABLE"),
    ({"bindings": "2"}, "AMBIGUOUS_SOURCE_BINDINGS"), ({"url_conflicts": "1"}, "SOURCE_URL_CONFLICT"), ({"aliases": "1"}, "LEGACY_ALIAS_REQUIRES_EXISTING_REVIEW"), ({"duplicates": "1"}, "POSSIBLE_DUPLICATE_LISTING"),
    ({"url": "'http://a.example/1'"}, "UNVERIFIED_SOURCE_URL"), ({"title": "' '"}, "MISSING_LISTING_FACTS"), ({"city": "'oakdale'"}, "OUTSIDE_TARGET_CITY"), ({"raw": "''", "source_title": "'for rent'"}, "NO_ORIGINAL_SOURCE_TEXT"), ({"source": "'MAIL'"}, "UNSUPPORTED_SOURCE"),
    ({"published": "CAST(NULL AS TIMESTAMP)"}, "SOURCE_FRESHNESS_UNVERIFIED"), ({"published": "TIMESTAMP '2024-03-03 00:00:00'"}, "SOURCE_DATE_IN_FUTURE"), ({"published": "TIMESTAMP '2024-01-01 00:00:00'"}, "ORIGINAL_PUBLICATION_TOO_OLD"),
    ({"published": "CAST(NULL AS TIMESTAMP)", "first_seen": "TIMESTAMP '2024-02-25 00:00:00'"}, ""), ({"city_exact": "false"}, "SOURCE_CITY_NOT_EXPLICIT"), ({"city_exact": "false", "city_flags": "array('OTHER_CITY', 'NO_AREA')"}, "OTHER_CITY,NO_AREA"),
    ({"raw": "'House, $450 a month'"}, ""), ({"raw": "'House'", "monthly": "array(450D, 450D)"}, "SOURCE_RENT_NOT_EXPLICIT"), ({"raw": "'House for rent $450 or for sale'"}, "MIXED_OR_SALE_OFFER"), ({"raw": "'For rent: already rented'"}, "SOURCE_NO_LONGER_AVAILABLE"),
    ({"payload_ok": "false"}, "UNPARSEABLE_SOURCE_PAYLOAD"), ({"rejected": "true"}, "AI_CLASSIFIED_UNSUPPORTED"), ({"offer_price": "500D"}, "CONTRADICTORY_STRUCTURED_SOURCE_PRICE"), ({"stated_price": "400D", "monthly": "array(450D, 450D)"}, "STRUCTURED_PRICE_MISMATCH"),
    ({"stated_price": "400D"}, ""), ({"monthly": "CAST(NULL AS ARRAY<DOUBLE>)"}, "MONTHLY_PRICE_NOT_CONFIRMED_BY_SOURCE"), ({"monthly": "array(450D, 500D)"}, "CONTRADICTORY_MONTHLY_PRICES"),
    ({"monthly": "CAST(NULL AS ARRAY<DOUBLE>)", "offer_price": "450D", "source_title": "'For rent'"}, ""), ({"monthly": "CAST(NULL AS ARRAY<DOUBLE>)", "asking": "array(450D)", "source": "'GROUP'", "group_rent": "true"}, ""),
    ({"payload_city": "'Oakdale'"}, "STRUCTURED_CITY_CONFLICT"), ({"payload_type": "'for sale'"}, "STRUCTURED_SALE_OFFER"), ({"beds_conflict": "true", "source_beds": "CAST(NULL AS INT)"}, "CONTRADICTORY_SOURCE_BEDROOM_COUNTS"),
    ({"baths_conflict": "true", "source_baths": "CAST(NULL AS INT)"}, "CONTRADICTORY_SOURCE_BATHROOM_COUNTS"), ({"own_beds": "3"}, "BEDROOMS_CONTRADICT_SOURCE"), ({"own_baths": "2"}, "BATHROOMS_CONTRADICT_SOURCE"),
    ({"source_beds": "CAST(NULL AS INT)"}, "UNSUPPORTED_CANONICAL_BEDROOM_COUNT"), ({"source_baths": "CAST(NULL AS INT)"}, "UNSUPPORTED_CANONICAL_BATHROOM_COUNT"), ({"text_beds": "5"}, "CANONICAL_BEDROOM_TEXT_CONTRADICTS_SOURCE"), ({"text_baths": "5"}, "CANONICAL_BATHROOM_TEXT_CONTRADICTS_SOURCE"),
    ({"own_beds": "CAST(NULL AS INT)", "text_beds": "CAST(NULL AS INT)", "price": "CAST(NULL AS DOUBLE)"}, "STRUCTURED_PRICE_MISMATCH,MONTHLY_PRICE_NOT_CONFIRMED_BY_SOURCE,CONTRADICTORY_MONTHLY_PRICES"),
]


def hold_policy(spark, d):
    n = len(CASES)
    cells = {}
    for name, value in PASSES.items():
        changed = {i: of[name] for i, (of, _) in enumerate(CASES) if name in of}
        cells[name] = F.expr("CASE " + " ".join(f"WHEN o_orderkey % {n} = {i} THEN {v}" for i, v in changed.items()) + f" ELSE {value} END" if changed else value)
    rows = table(spark, d, "orders").select("o_orderkey", *[c.alias(k) for k, c in cells.items()])
    codes = moderation.moderation_codes({k: F.col(k) for k in PASSES}, F.expr("TIMESTAMP '2024-03-01 00:00:00'"), "riverton", ("SITE", "GROUP"), "SITE", "GROUP")
    return rows.select(F.col("o_orderkey").alias("id"), F.array_join(codes, ",").alias("codes"))


QUERIES["hold_policy"] = hold_policy
SQL["hold_policy"] = f"SELECT o_orderkey AS id, v.codes FROM orders JOIN (VALUES {', '.join(f'({i}, {c!r})' for i, (_, c) in enumerate(CASES))}) v(k, codes) ON o_orderkey % {len(CASES)} = v.k"


# Each number has records 0 to 3: 0 is mapped in half of the numbers, 1 is like it, 2 has another price, 3 another price and title.
@query("""WITH r AS (SELECT p_partkey AS g, i, p_partkey * 10 + i AS id, p_partkey % 12 AS k FROM part, (VALUES (0), (1), (2), (3)) v(i)),
s AS (SELECT *, CASE WHEN k = 1 THEN 'legacy_url_missing_or_conflicting' WHEN k = 2 THEN 'legacy_not_approved_active_rental' WHEN k = 3 THEN 'canonical_source_not_found' WHEN k = 4 THEN 'canonical_source_url_mismatch'
 WHEN k = 5 THEN 'ambiguous_canonical_source' WHEN k = 6 THEN 'canonical_not_visible' WHEN k = 7 AND i < 2 OR k <> 7 AND i >= 2 AND k <> 10 AND k <> 11 OR k IN (10, 11) AND i < 2 THEN 'canonical_fields_mismatch'
 WHEN k = 8 AND i = 0 THEN 'legacy_alias_collision' WHEN k = 8 THEN 'source_identity_alias_collision' WHEN k = 9 THEN 'trusted_sibling_alias_not_found'
 WHEN k = 7 THEN 'trusted_sibling_alias_not_found' WHEN k = 11 AND i = 3 OR k = 10 AND i = 3 THEN 'trusted_sibling_alias_not_found' END AS reason FROM r)
SELECT id, CASE WHEN reason IS NOT NULL THEN 'blocked' WHEN i = 0 THEN 'already_mapped' ELSE 'safe' END AS status,
 coalesce(reason, CASE WHEN i = 0 THEN 'existing_verified_alias' WHEN i = 1 THEN 'verified_duplicate_source_identity' ELSE 'verified_price_revision_same_source' END) AS reason,
 CASE WHEN reason IS NULL THEN g END AS listing, CASE WHEN reason IS NULL AND i > 0 THEN g * 10 END AS sibling FROM s""")
def alias_repairs(spark, d):
    g, i = F.col("p_partkey"), F.col("i")
    k = g % 12
    base = table(spark, d, "part").select("p_partkey")
    legacy = base.select("p_partkey", F.explode(F.array(*map(F.lit, range(4)))).alias("i"))
    revised = k.isin(7, 10, 11)  # the listing now has the price of records 2 and 3
    legacy = legacy.select(
        (g * 10 + i).alias("id"), F.when(k != 1, g).alias("ad"), (k != 2).alias("active"), F.when(i == 3, "Another house").otherwise(" Nice  House").alias("title"), F.lit(2).alias("beds"),
        F.when(i < 2, 300).otherwise(350).alias("price"), F.lit("USD").alias("currency"), F.lit("riverton").alias("city"), F.lit("house").alias("category"), F.lit("rent").alias("kind"),
    )
    current = base.where(k != 3).select(g.alias("ad"), F.explode(F.when(k == 5, F.array(g, g + 1)).otherwise(F.array(g))).alias("listing"), (k != 4).alias("same_url"), (k != 6).alias("visible"), F.lit("nice house").alias("title"), F.lit(2).alias("beds"), F.when(revised, 350).otherwise(300).alias("price"), F.lit("USD").alias("currency"), F.lit("riverton").alias("city"), F.lit("house").alias("category"))
    aliases = base.where(~k.isin(7, 9)).select((g * 10).alias("alias"), F.when(k == 8, g + 1).otherwise(g).alias("listing"))
    return moderation.alias_repairs(legacy, current, aliases)
