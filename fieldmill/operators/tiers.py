"""How sure a listing's offer and place are, and whether it fits a saved search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.geo import haversine_km
from fieldmill.operators.predicates import any_of

# Wording of offers, as substrings of lower-case text.
RENT_WORDS = ("for rent", "rental", " rent", "lease", "ជួល")
SALE_WORDS = ("for sale", "selling", " sale", " sell", "លក់")
MIXED_OFFERS = ("rent_or_sale", "mixed", "rent_and_sale")


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(any_of([F.contains(F.lower(c), F.lit(w)) for w in words]), F.lit(False))


def offer_tier(offer: Column, body: Column, price: Column | None = None) -> Column:
    """EXACT for a stated rent, PROBABLE for a mixed offer or rent wording, else UNKNOWN. With a price filter an unknown price makes EXACT PROBABLE."""
    offer = F.lower(F.coalesce(offer, F.lit("")))
    tier = F.when(offer == "rent", "EXACT").when(offer.isin(*MIXED_OFFERS) | has_any(body, RENT_WORDS), "PROBABLE").otherwise("UNKNOWN")
    return tier if price is None else F.when((tier == "EXACT") & (price.isNull() | (price <= 0)), "PROBABLE").otherwise(tier)


def city_tier(structured: Column, body: Column, source: Column, city: str, local: tuple[str, ...]) -> Column:
    """EXACT_CITY if a field names the city or the text places itself in it, PROBABLE_CITY by the source's city or a local name, else UNKNOWN_CITY."""
    placed = has_any(structured, (city,)) | has_any(body, (f"in {city}", f"location: {city}"))
    return F.when(placed, "EXACT_CITY").when(F.coalesce(source == city, F.lit(False)) | has_any(F.concat_ws(" ", structured, body), local), "PROBABLE_CITY").otherwise("UNKNOWN_CITY")


def city_evidence(structured: Column, body: Column, source: Column, city: str, local: tuple[str, ...]) -> Column:
    only = F.coalesce(source == city, F.lit(False)) & ~has_any(F.concat_ws(" ", structured, body), (city, *local))
    return F.when(only, "SOURCE_PRIOR_ONLY").otherwise("LOCAL_EVIDENCE")


def out_of_area(structured: Column, extracted: Column, title: Column, body: Column, home: str, others: tuple[str, ...]) -> Column:
    """A field or the title names another city, or the text or an extracted city does and no field names the home city."""
    placed = tuple(x for o in others for x in (f"in {o}", f"location: {o}", f"{o}, cambodia"))
    at_home = has_any(structured, (home,))
    return has_any(structured, others) | has_any(title, placed) | ((has_any(extracted, others) | has_any(body, placed)) & ~at_home & ~has_any(extracted, (home,)))


def matches_search(listing: dict[str, Column], search: dict[str, Column]) -> Column:
    """Whether a listing fits a saved search: kind and city must agree, an unknown category, lease or number of rooms passes, an unknown price does not.

    Searches count dollars and listings cents. A preferred lease of 5 means up to five months, of 6 six and more; 4 rooms mean four and more.
    """
    either = lambda a, b, c: a.isNull() | b.isNull() | c
    p, s = listing, search
    lease = either(s["lease"], p["min_lease"], F.when(s["lease"] == 5, p["min_lease"] <= 5).when(s["lease"] == 6, p["min_lease"] >= 6).otherwise(True))
    rooms = p["bedrooms"].isNull() | F.coalesce(F.size(s["bedrooms"]) <= 0, F.lit(True)) | F.exists(s["bedrooms"], lambda b: F.when(b == 4, p["bedrooms"] >= 4).otherwise(p["bedrooms"] == b))
    place = F.coalesce(F.size(s["places"]) <= 0, F.lit(True)) | F.exists(s["places"], lambda x: F.contains(F.lower(p["place"]), F.lower(x)) | F.contains(F.lower(x), F.lower(p["place"])))
    low, high = s["low"].isNull() | (p["price"] >= s["low"] * 100), s["high"].isNull() | (p["price"] <= s["high"] * 100)
    every = [s["kind"] == p["kind"], s["city"] == p["city"], either(s["category"], p["category"], s["category"] == p["category"]), ~s["pool"] | p["pool"], lease, rooms, place, low, high]
    out = F.lit(True)
    for c in every:
        out = out & F.coalesce(c, F.lit(False))
    return out


def first_reason(rules: list[tuple[str, Column]], default: str) -> Column:
    """The first rule that holds: one reason a row, so that an exclusion funnel adds up."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules], F.lit(default))


def exclusion_funnel(rows: DataFrame, rules: list[tuple[str, Column]], default: str = "shown") -> DataFrame:
    return rows.groupBy(first_reason(rules, default).alias("reason")).agg(F.count("*").alias("n"))


def geography_tier(raw: Column, derived: Column, source: Column, home: tuple[str, ...], areas: tuple[str, ...], others: tuple[str, ...]) -> Column:
    """CONTRADICTION_CITY, GEOGRAPHY_CONFLICT, EXACT_CITY, PROBABLE_CITY or UNKNOWN_CITY: the source's own words first, then fields derived from them."""
    asserted = has_any(raw, tuple(x for o in others for x in (f"in {o}", f"location: {o}")))
    exact, area = has_any(raw, home), has_any(raw, areas)
    outside = asserted | has_any(raw, others) | has_any(derived, others)
    probable = area | has_any(derived, (*home, *areas)) | has_any(source, home)
    return F.when(asserted & ~exact & ~area, "CONTRADICTION_CITY").when(outside, "GEOGRAPHY_CONFLICT").when(exact, "EXACT_CITY").when(probable, "PROBABLE_CITY").otherwise("UNKNOWN_CITY")


def plausible_pin(lat: Column, lng: Column, centre: tuple[float, float], radius_km: float, water: tuple[float, float, float, float] | None = None) -> Column:
    """Whether a pin lies within the radius of a city's centre and not in a box of water (south, west, north, east)."""
    near = haversine_km(lat, lng, F.lit(centre[0]), F.lit(centre[1])) <= radius_km
    wet = lat.between(water[0], water[2]) & lng.between(water[1], water[3]) if water else F.lit(False)
    return F.coalesce(near & ~wet, F.lit(False))


def location_vote(pin: Column, text: Column, attribute: Column) -> Column:
    """struct(area, support) of three sources that name an area: two that agree, else the pin, the text, the attribute."""
    agreed = F.when(pin == text, pin).when(pin == attribute, pin).when(text == attribute, text)
    area = F.coalesce(agreed, pin, text, attribute)
    votes = sum((F.when(c == area, 1).otherwise(0) for c in (pin, text, attribute)), F.lit(0))
    return F.struct(area.alias("area"), votes.alias("support"))
