"""Filters of catalogue queries as columns, so that Catalyst can push them into the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.plans.spec import NullPolicy, SearchSpec

#: Bedrooms from which a choice means "so many or more".
OPEN_ENDED = 4


def any_of(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


def all_of(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def price_between(price: Column, low: int | None, high: int | None, policy: NullPolicy) -> Column:
    """Within both bounds; contradictory bounds match nothing, and what an unknown price does is the policy's choice."""
    if low is not None and high is not None and low > high:
        return F.lit(False)
    terms = ([price >= low] if low is not None else []) + ([price <= high] if high is not None else [])
    if not terms:
        return F.lit(True)
    known = all_of(terms)
    return known if policy is NullPolicy.LEGACY else price.isNull() | (price <= 0) | known


def bedrooms_in(bedrooms: Column, wanted: tuple[int, ...]) -> Column:
    """One of the exact numbers, or OPEN_ENDED and more if that is among them."""
    exact = [n for n in wanted if n < OPEN_ENDED]
    terms = ([bedrooms.isin(exact)] if exact else []) + ([bedrooms >= OPEN_ENDED] if any(n >= OPEN_ENDED for n in wanted) else [])
    return any_of(terms) if terms else F.lit(True)


def contains_text(columns: list[Column], text: str) -> Column:
    """Whether a column contains the text, case-insensitively; per cent signs and underscores are ordinary characters."""
    return any_of([F.contains(F.lower(c), F.lit(text.lower())) for c in columns])


def in_bounds(lat: Column, lng: Column, box: tuple[float, float, float, float], overscan: float) -> Column:
    """Within (lat, lng, lat, lng) in any order of corners, padded on each side by a share of its extent."""
    south, north = sorted((box[0], box[2]))
    west, east = sorted((box[1], box[3]))
    pad_lat, pad_lng = (north - south) * overscan, (east - west) * overscan
    return lat.between(south - pad_lat, north + pad_lat) & lng.between(west - pad_lng, east + pad_lng)


def has_member(array: Column, value: str) -> Column:
    return F.coalesce(F.exists(array, lambda x: F.lower(x) == value.lower()), F.lit(False))


def json_flag(json: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(json, path) == "true", F.lit(False))


def where(spec: SearchSpec) -> Column:
    c = lambda name: F.col(spec.column(name))
    terms = [price_between(c("price"), spec.min_price, spec.max_price, spec.policy)]
    if spec.bedrooms:
        terms.append(bedrooms_in(c("bedrooms"), spec.bedrooms))
    if spec.max_lease is not None:
        terms.append(c("min_lease").isNull() | (c("min_lease") <= spec.max_lease))
    if spec.categories:
        terms.append(c("category").isin(*spec.categories))
    if spec.locations:
        terms.append(any_of([F.contains(F.lower(c("location")), F.lit(x.lower())) for x in spec.locations]))
    if spec.text:
        terms.append(contains_text([c("title"), c("category")], spec.text))
    if spec.bounds:
        terms.append(in_bounds(c("lat"), c("lng"), spec.bounds, spec.overscan))
    return all_of(terms)


def order(spec: SearchSpec) -> list[Column]:
    """Unknown and non-positive prices come last either way; ties go to the later date, then the larger id."""
    price, date, ident = F.col(spec.column("price")), F.col(spec.column("date")), F.col(spec.column("id"))
    unknown = F.when(price.isNull() | (price <= 0), 1).otherwise(0)
    if spec.sort in ("price_asc", "price_desc"):
        return [unknown.asc(), price.asc() if spec.sort == "price_asc" else price.desc(), date.desc_nulls_last(), ident.desc()]
    return [date.desc_nulls_last(), ident.desc()]


def search(listings: DataFrame, spec: SearchSpec, most: int = 500) -> DataFrame:
    """A page: filter, order, clamp. Spark keeps offset + limit rows a task, not the sorted table."""
    limit, offset = min(max(spec.limit, 1), most), max(spec.offset, 0)
    return listings.where(where(spec)).orderBy(*order(spec)).offset(offset).limit(limit)


def total(listings: DataFrame, spec: SearchSpec) -> DataFrame:
    """The number of matches, as a scan of its own: a window over everything would gather all rows in one task."""
    return listings.where(where(spec)).agg(F.count("*").alias("total"))
