"""The whole record of a listing as clients get it: presentation, contacts with links, amenities as labels, provenance and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions import contacts
from fieldmill.functions.text import digits, phone_e164
from fieldmill.operators.records import presentation

#: Months of deposit that facts may state.
MOST_MONTHS = 120
#: Columns that stay as they are stored.
STORED = ("description", "currency", "offer", "category", "bedrooms", "bathrooms", "min_lease", "has_pool", "location", "area_key", "city", "maps_url", "source_url", "posted_at", "created_at", "match_tier", "city_tier", "city_evidence", "public_ref", "review_status", "review_reason")


def deposit_months(facts: Column) -> Column:
    """Months of deposit of a listing's facts (JSON), if they are a number over 0 and up to MOST_MONTHS; null for a broken text."""
    v = F.try_variant_get(F.try_parse_json(facts), "$.deposit_months", "variant")
    months = F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    return F.when((months > 0) & (months <= MOST_MONTHS), months)


def international_digits(c: Column, country: str = "855") -> Column:
    """A number's digits with the country's code for a national 0 or where up to nine digits have neither; null below seven digits."""
    d = digits(c)
    whole = F.when(F.startswith(d, F.lit("0")), F.concat(F.lit(country), F.substring(d, 2, 99))).when(F.startswith(d, F.lit(country)) | (F.length(d) > 9), d).otherwise(F.concat(F.lit(country), d))
    return F.when(F.length(d) >= 7, whole)


def phone_shown(c: Column) -> Column:
    """Numbers in domestic form if all of them are the country's; else as they are stored."""
    parts = F.filter(F.transform(F.split(c, contacts.LISTED), lambda x: F.trim(x)), lambda x: x != "")
    local = (F.size(parts) > 0) & F.forall(parts, lambda x: phone_e164(x).isNotNull())
    return F.when(F.coalesce(local, F.lit(False)), F.coalesce(contacts.formatted(c), c)).otherwise(c)


def chat_shown(c: Column) -> Column:
    """A chat as a handle, an invitation (+...), or a number in domestic form; other texts as they are."""
    c = F.trim(c)
    path = F.regexp_replace(F.regexp_extract(c, r"(?i)^https?://[^/?#]+([^?#]*)", 1), "^/+|/+$", "")
    link = F.when(F.startswith(path, F.lit("+")), path).otherwise(F.concat(F.lit("@"), path))
    return F.when(c.rlike("(?i)^https?://"), link).when(F.startswith(c, F.lit("@")) | phone_e164(c).isNull(), c).otherwise(F.coalesce(contacts.formatted(c), c))


def amenity_labels(tags: Column, labels: dict[str, str], pool: Column, pool_label: str = "Swimming Pool") -> Column:
    """The labels of known tags, each once, in order of the tags; the pool's goes where the listing has a pool of its own. Unknown tags have no label."""
    key = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    table = F.create_map(*[F.lit(x) for k, v in labels.items() for x in (k.replace("_", " "), v)])
    found = F.array_distinct(F.array_compact(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.get(F.array(table[key(x)]), F.lit(0)))))
    return F.when(F.coalesce(pool, F.lit(False)), F.array_remove(found, pool_label)).otherwise(found)


def client_records(rows: DataFrame, labels: dict[str, str], favorites: DataFrame | None = None, all_photos: bool = False) -> DataFrame:
    """Each listing as presentation() gives it, with STORED as it is and contact, amenities, deposit_months, original_url, warnings and favorite.

    rows: what presentation() reads, STORED, whatsapp, facts (JSON), amenities and warnings (arrays), original_url. favorites: id,
    of any number of repeats; without it favorite is null. Missing arrays are empty. One shuffle by id for favorites.
    """
    c = F.col
    none = F.array().cast("array<string>")
    out = rows.select(
        *presentation(all_photos), *[c(x) for x in STORED], deposit_months(c("facts")).alias("deposit_months"), amenity_labels(c("amenities"), labels, c("has_pool")).alias("amenities"),
        F.coalesce(F.replace("original_url", F.lit("web.facebook.com"), F.lit("www.facebook.com")), F.lit("")).alias("original_url"), F.coalesce("warnings", none).alias("warnings"),
        F.struct(
            phone_shown(c("phone")).alias("phone"), chat_shown(c("chat")).alias("telegram"), F.coalesce(contacts.formatted(F.trim("whatsapp")), F.trim("whatsapp")).alias("whatsapp"),
            F.concat(F.lit("https://wa.me/"), international_digits(c("whatsapp"))).alias("whatsapp_link"),
        ).alias("contact"),
    )
    if favorites is None:
        return out.withColumn("favorite", F.lit(None).cast("boolean"))
    liked = favorites.select(c("id").alias("_liked")).distinct()
    return out.join(liked, out["id"] == liked["_liked"], "left").withColumn("favorite", c("_liked").isNotNull()).drop("_liked")
