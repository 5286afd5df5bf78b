"""Listings and what a model found in them: which value wins, whether a listing is admitted, and how it is to be reviewed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.policy import category_of

#: Share of Khmer letters above which a description counts as not translated.
KHMER = 0.1
#: Fields that verified facts decide alone where there are any, and fields that keep the listing's value where the model has none.
DECIDED, FILLED = ("bedrooms", "bathrooms", "deposit", "min_lease", "has_pool"), ("electricity", "water", "cleaning", "pet_friendly")


def khmer_share(text: Column) -> Column:
    t = F.trim(text)
    return F.length(F.regexp_replace(t, r"[^\x{1780}-\x{17FF}]", "")) / F.greatest(F.length(t), F.lit(1))


def merged(listings: DataFrame, models: DataFrame, city_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each listing with what the model found: outcome, merged fields, review_status, review_reason.

    listings: id, title, description, price, currency, category, city, location, property_type, DECIDED, FILLED and amenities
    (array); other columns stay as they are. models, at most one for an id: id, is_real_estate, admission_reason, rejection_reason,
    title, description, price, category, location, property_type, DECIDED, FILLED, amenities and has_facts: whether verified facts
    were made, whose values (price, currency, DECIDED) then decide alone, nulls included. Without them the platform's
    price stays, and other values are the model's or else the listing's. Categories follow the kind of property; city_of(location)
    corrects the city where it knows the place. outcome: unread (no answer), rejected (not housing, or land), untranslated, merged;
    only merged listings change. A null id has no answer. Models are joined by id, one shuffle of each side.
    """
    names = ("is_real_estate", "admission_reason", "rejection_reason", "title", "description", "price", "currency", "category", "location", "property_type", *DECIDED, *FILLED, "amenities", "has_facts")
    answers = models.select(F.col("id").alias("_id"), F.struct(*[F.col(n) for n in names]).alias("_m"))
    rows = listings.join(answers, F.col("id") == F.col("_id"), "left")
    m, own = F.col("_m"), F.col
    sure = F.coalesce(m["has_facts"], F.lit(False))
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    outcome = F.when(m.isNull(), "unread").when((~m["is_real_estate"]) | (m["category"] == "land"), "rejected").when(khmer_share(F.coalesce(m["description"], F.lit(""))) > KHMER, "untranslated").otherwise("merged")
    location = F.coalesce(filled(own("location")), filled(m["location"]))
    kind = F.coalesce(m["property_type"], own("property_type"))
    place = city_of(location) if city_of else F.lit(None).cast("string")
    priced = m["price"].isNotNull() & m["currency"].isNotNull()
    listed = lambda x: F.when(F.size(x) > 0, x)
    new = {
        "title": F.coalesce(filled(m["title"]), own("title")), "description": F.coalesce(filled(m["description"]), own("description")),
        "price": F.when(sure, F.when(priced, m["price"])).otherwise(F.coalesce(own("price"), m["price"])), "currency": F.when(sure, m["currency"]).otherwise(own("currency")),
        "category": F.coalesce(category_of(kind), filled(m["category"]), own("category")), "city": F.coalesce(place, own("city")), "location": location, "property_type": kind,
        **{n: F.when(sure, m[n]).otherwise(F.coalesce(m[n], own(n))) for n in (*DECIDED, *FILLED)},
        "amenities": F.coalesce(listed(m["amenities"]), own("amenities")),
    }
    approved = F.coalesce(m["is_real_estate"], F.lit(False)) & (~sure | priced)
    reason = (
        F.when(own("outcome") == "unread", "model's answer unavailable")
        .when(own("outcome") == "rejected", F.coalesce(filled(m["admission_reason"]), filled(m["rejection_reason"]), F.when(m["category"] == "land", "land is not supported").otherwise("rejected as not housing")))
        .when(own("outcome") == "untranslated", "translation of low quality")
        .when(~approved, F.when(sure & ~priced, "monthly rent or currency unknown").otherwise(F.coalesce(filled(m["admission_reason"]), F.lit("admission missing or uncertain"))))
    )
    rows = rows.withColumn("outcome", outcome)
    kept = [F.when(own("outcome") == "merged", new[c]).otherwise(own(f"`{c}`")).alias(c) if c in new else own(f"`{c}`") for c in listings.columns]
    status = F.when((own("outcome") == "merged") & approved, "approved").otherwise("pending")
    return rows.select(*kept, "outcome", status.alias("review_status"), reason.alias("review_reason"))
