"""Records as readers get them: projection over the tables of a listing, presentation, enrichment, and reads held against each other."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions import adverts, geo, places, rooms, text
from fieldmill.functions.facts import source_price

#: Photos of a listing in a list of results.
PHOTOS = 8


def payload_photos(payload: Column) -> Column:
    """Addresses of photos in a source's JSON: the first list among the usual keys, of strings or of objects with an address."""
    raw = F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ("photos", "listing.photos", "image_urls", "images")])
    url = lambda x: F.when(F.startswith(x, F.lit("{")), F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in ("url", "uri", "src")])).otherwise(x)
    return F.coalesce(F.array_distinct(F.filter(F.transform(F.from_json(raw, "array<string>"), url), lambda x: x != "")), F.array().cast("array<string>"))


def projection(listings: DataFrame, estates: DataFrame, occurrences: DataFrame, items: DataFrame, identifiers: DataFrame, media: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row a listing, with its place, its occurrence, the item behind that, contacts, photos and review.

    listings: listing, estate, city, facts (JSON). estates: estate, lat, lng, kind, address, estate_city. occurrences, one a
    listing: listing, occurrence, item, url. items: item, text, payload (JSON). identifiers: item, type, value. media: listing,
    occurrence, media, photo. reviews: listing, review. Linked media come before the payload's photos; contacts are joined by " / "
    in order. Each side is aggregated to its key before it is joined, so that no join multiplies rows.
    """
    c = F.col
    values = lambda *types: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(c("type").isin(*types), c("value")))), " / "), F.lit(""))
    contacts = identifiers.groupBy("item").agg(values("PHONE", "WHATSAPP").alias("_phone"), values("TELEGRAM").alias("contact_chat"))
    first = media.where("photo <> ''").groupBy("listing", "occurrence", "photo").agg(F.min("media").alias("m"))
    photos = first.groupBy("listing", "occurrence").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "photo"))), lambda x: x["photo"]).alias("_linked"))
    out = listings.join(estates, "estate", "left").join(occurrences, "listing", "left").join(items, "item", "left")
    out = out.join(contacts, "item", "left").join(photos, ["listing", "occurrence"], "left").join(reviews, "listing", "left")
    fact = lambda k: F.get_json_object("facts", f"$.{k}")
    return out.withColumns({
        "projection_city": F.coalesce(F.nullif("city", F.lit("")), F.nullif("estate_city", F.lit(""))),
        "offer_type": fact("offer_type"), "maps_url": fact("maps_urls[0]"), "electricity": fact("electricity_rate"), "water": fact("water_rate"), "landmarks": F.from_json(fact("landmarks"), "array<string>"), "marketing_landmarks": F.from_json(fact("marketing_landmarks"), "array<string>"),
        "contact_phone": F.coalesce("_phone", F.get_json_object("payload", "$.direct_contact.phone"), F.get_json_object("payload", "$.listing.phone")),
        "photos": F.coalesce("_linked", payload_photos(c("payload"))),
    }).drop("_phone", "_linked")


def chat_link(c: Column) -> Column:
    """Address of a chat's handle or address; null for other texts."""
    name = F.regexp_extract(F.trim(c), r"(?i)^(?:@|(?:https?://)?(?:www\.)?t\.me/)(\+?[A-Za-z0-9_]{4,32})/?$", 1)
    return F.when(name != "", F.concat(F.lit("https://t.me/"), name))


def presentation(all_photos: bool = False) -> list[Column]:
    """The columns of presented(): id, title, price_usd, property_type, utilities, deposit_usd, place, photos, thumbnail, links.

    rows: id, title, description, price and deposit (cents), category, property_type, electricity, water, cleaning, restrictions,
    location, area_key, city, lat, lng, maps_url, photos, phone, chat. What is not stored is taken from title and description.
    """
    c = F.col
    full = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    kind = F.coalesce(F.nullif(F.trim("property_type"), F.lit("")), adverts.property_type(full, c("category")), c("category"), F.lit("Property"))
    point = F.when(c("lat").isNotNull() & c("lng").isNotNull(), F.struct(c("lat").cast("double").alias("lat"), c("lng").cast("double").alias("lng"))).otherwise(geo.coordinates(c("maps_url")))
    pictures = F.coalesce("photos", F.array().cast("array<string>"))
    phone = text.phone_e164(c("phone"))
    return [
        "id", F.coalesce(F.nullif("title", F.lit("")), F.concat(kind, F.lit(" in "), F.coalesce(F.nullif("location", F.lit("")), c("city")))).alias("title"),
        F.floor(c("price") / 100 + 0.5).cast("long").alias("price_usd"), kind.alias("property_type"),
        F.coalesce("electricity", adverts.electricity(full)).alias("electricity"), F.coalesce("water", adverts.water(full)).alias("water"), F.coalesce("cleaning", adverts.cleaning(full)).alias("cleaning"),
        F.when(F.size("restrictions") > 0, c("restrictions")).otherwise(adverts.restrictions(full)).alias("restrictions"),
        F.when(c("deposit") > 0, F.floor(c("deposit") / 100 + 0.5).cast("long")).alias("deposit_usd"),
        point.alias("coordinates"), F.when(point.isNotNull(), "exact").when(c("area_key").isNotNull(), "district").otherwise("city").alias("precision"),
        (pictures if all_photos else F.slice(pictures, 1, PHOTOS)).alias("photos"), F.get(pictures, 0).alias("thumbnail"),
        F.coalesce(phone, c("phone")).alias("phone"), F.concat(F.lit("tel:"), phone).alias("phone_link"), F.coalesce(chat_link(c("chat")), F.concat(F.lit("https://t.me/"), phone)).alias("chat_link"),
    ]


def presented(rows: DataFrame, all_photos: bool = False) -> DataFrame:
    """Records as clients get them: the columns of presentation()."""
    return rows.select(*presentation(all_photos))


def cleaned(raw: DataFrame, areas: list[places.Area], marks: list[places.Landmark], noise: tuple[str, ...] = ()) -> DataFrame:
    """Raw posts as records with warnings. raw: id, title, description, price (or null), currency (or null), city, location.

    A price without a currency, or none at all, is read from the text, else in dollars. The area comes from the location, then
    from the text, then from landmarks; a city is corrected only where all landmarks of the text lie in one other city.
    """
    c = F.col
    body = F.concat_ws("\n", "title", "description")
    # What several columns read is a column of its own, which Spark computes once.
    raw = raw.withColumns({"_read": source_price(body), "_rooms": rooms.room_counts(body), "_found": places.landmarks(body, marks)})
    raw = raw.withColumn("_near", places.of_landmarks(c("_found"), marks))
    raw = raw.withColumn("_area", F.coalesce(places.find_area(c("location"), areas, noise), places.find_area(body, areas, noise), c("_near")["area"]))
    read, found, near, area = c("_read"), c("_found"), c("_near"), c("_area")
    city = F.coalesce(near["city"], c("city"))
    price = F.coalesce(F.when(c("price") > 0, c("price").cast("double")), read["price"])
    currency = F.when(c("currency").isin("USD", "KHR"), c("currency")).otherwise(F.coalesce(read["currency"], F.lit("USD")))
    warn = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    said = c("_rooms")
    return raw.select(
        "id", F.coalesce(F.nullif(text.collapse(c("title")), F.lit("")), F.lit("Untitled")).alias("title"), price.alias("price"), F.when(price.isNotNull(), currency).alias("currency"), city.alias("city"), area.alias("area"),
        adverts.category(body).alias("category"), adverts.offer_type(body).alias("offer"), said["bedrooms"].alias("bedrooms"), said["bathrooms"].alias("bathrooms"), found.alias("landmarks"),
        F.array_compact(F.array(
            warn(price.isNull(), "price_missing"), warn(price.isNotNull() & ~c("currency").isin("USD", "KHR") | price.isNotNull() & c("currency").isNull(), "currency_inferred"),
            warn(city != c("city"), "city_corrected"), warn(area.isNull(), "area_unknown"), warn(said["bedrooms_conflict"], "bedrooms_conflict"), warn(said["bathrooms_conflict"], "bathrooms_conflict"),
        )).alias("warnings"),
    )


def enriched(rows: DataFrame, proposals: dict[str, Column]) -> DataFrame:
    """Rows whose null fields are filled by proposals, with changes: array<struct(field, new)> of what was filled."""
    changes = [F.when(F.col(k).isNull() & v.isNotNull(), F.struct(F.lit(k).alias("field"), v.cast("string").alias("new"))) for k, v in proposals.items()]
    return rows.withColumns({**{k: F.coalesce(F.col(k), v) for k, v in proposals.items()}, "changes": F.array_compact(F.array(*changes))})


def enrichment_counts(rows: DataFrame) -> DataFrame:
    """One row of enriched(): rows, changed, and of each field the number of rows that it was filled in."""
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.size("changes") > 0).alias("changed")).select(F.lit("*").alias("field"), "n", "changed")
    fields = rows.select(F.explode("changes").alias("x")).groupBy(F.col("x.field").alias("field")).agg(F.count("*").alias("changed"))
    return total.unionByName(fields.select("field", F.lit(None).cast("long").alias("n"), "changed"))


def parity(reads: dict[str, DataFrame], key: str) -> DataFrame:
    """a, b, both, only_a, only_b of each pair of reads: how many keys they share and how many only one has. One shuffle by key."""
    every = None
    for name, df in reads.items():
        part = df.select(F.col(key).alias("k"), *[F.lit(n == name).alias(n) for n in reads])
        every = part if every is None else every.unionByName(part)
    keys = every.groupBy("k").agg(*[F.max(n).alias(n) for n in reads])
    pairs = list(combinations(reads, 2))
    sums = keys.agg(*[F.count_if(cond).alias(f"{i}_{what}") for i, (a, b) in enumerate(pairs) for what, cond in (("both", F.col(a) & F.col(b)), ("a", F.col(a) & ~F.col(b)), ("b", ~F.col(a) & F.col(b)))])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}_both").alias("both"), F.col(f"{i}_a").alias("only_a"), F.col(f"{i}_b").alias("only_b")) for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")
