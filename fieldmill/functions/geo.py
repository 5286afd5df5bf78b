"""Geography as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def jitter(ident: Column, spread: float = 0.003) -> Column:
    """A fixed offset of at most `spread` degrees for an identifier."""
    x = F.sin(ident * 12.9898) * 43758.5453
    return ((x - F.floor(x)) * 2 - 1) * spread


def coordinates(url: Column) -> Column:
    """struct(lat, lng) of a map address: !3d!4d, then @lat,lng, then a q, ll or query parameter; null if none is plausible."""
    n = r"(-?[0-9]+\.[0-9]+)"
    forms = [rf"!3d{n}!4d{n}", rf"@{n},{n}", rf"[?&](?:q|ll|query)={n},(?:%20)?{n}"]
    lat, lng = (F.coalesce(*[F.nullif(F.regexp_extract(url, p, i), F.lit("")) for p in forms]).try_cast("double") for i in (1, 2))
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))
