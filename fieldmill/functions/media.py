"""Addresses of pictures, and identifiers in texts and nested JSON, as columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from fieldmill.functions import text as T
from fieldmill.functions.rooms import one

# Pictures that are no photos, and where an address states a size.
JUNK = (
    r"/t39\.30808-1/",
    r"/p(40|50|60|75|100|160)x\1/",
    r"/s(40|50|60|75|100|160)x\1/",
    r"[?&]ctp=s(40|50|60|75|100|160)x\1",
    r"[?&]cstp=s(40|50|60|75|100|160)x\1",
    r"c\d+\.\d+\.\d+\.\d+",
    r"profile",
    r"avatar",
    r"emoji",
    r"static\.xx\.fbcdn\.net",
    r"rsrc\.php",
)
SIZES = (r"(?i)[?&]ctp=m?[sx]?(\d+)x(\d+)", r"(?i)[?&]cstp=m?[sx]?(\d+)x(\d+)", r"(?i)/(?:s|p|mx)(\d+)x(\d+)/", r"(?i)[?&]size=(\d+)x(\d+)")
CDN = "fbcdn.net"
# How texts give phones, mail, chats, codes and places.
PHONE = r"((?:\+?855|0)[1-9]\d{1,2}(?:[\s().-]*\d){6,8})"
EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
TELEGRAM = (r"(?i)(?:https?://)?(?:www\.)?t\.me/([a-zA-Z][a-zA-Z0-9_]{4,31})", r"(?i)(?:telegram|\btg\b)[^\n]{0,48}?@([a-zA-Z][a-zA-Z0-9_]{4,31})")
WHATSAPP = (r"(?i)(?:https?://)?(?:www\.)?wa\.me/(\+?\d{8,15})", r"(?i)(?:whatsapp|whats\s*app|wa)\s*[:-]\s*" + PHONE)
CODE = r"\s*(?:code|id|ref(?:erence)?|#)\s*[:#-]?\s*([A-Za-z0-9][A-Za-z0-9_-]{2,23})\b"
PROPERTY_CODE, AGENCY_CODE = r"(?i)\b(?:property|listing|house|room|unit)" + CODE, r"(?i)\b(?:agency|agent|company)" + CODE
MAPS = r"(?i)(https?://(?:maps\.app\.goo\.gl|goo\.gl/maps|maps\.google\.[a-z.]+|(?:www\.)?google\.[a-z.]+/maps)[^\s<>\"']*)"
PLACE = r"[?&](?:query_place_id|place_id)=([A-Za-z0-9_-]+)"
IMAGE = r"\.(?:jpe?g|png|webp|gif)(?:$|[?#])"


def identity(url: Column) -> Column:
    """Host and path; for a CDN that changes hosts and signs queries, the path. Null for what is not a web address."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.when(url.rlike("(?i)^https?://"), F.when((host == CDN) | F.endswith(host, F.lit("." + CDN)), F.concat(F.lit("fbcdn:"), path)).otherwise(F.concat(host, path)))


def identity_hash(urls: Column) -> Column:
    """One hash for a set of pictures in any order; null without any."""
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform(urls, identity))))
    return F.when(F.size(ids) > 0, F.sha2(F.array_join(ids, "\n"), 256))


def area(url: Column) -> Column:
    """Pixels that an address states; one that states none is taken for the original."""
    of = lambda p: F.nullif(F.regexp_extract(url, p, 1).try_cast("long") * F.regexp_extract(url, p, 2).try_cast("long"), F.lit(0))
    return F.coalesce(*[of(p) for p in SIZES], F.lit((1 << 53) - 1))


def junk(url: Column) -> Column:
    """Whether an address is an avatar's, a thumbnail's or an icon's."""
    out = F.lit(False)
    for p in JUNK:
        out = out | url.rlike(f"(?i){p}")
    return out


def clean_photos(urls: Column) -> Column:
    """Web addresses without avatars and thumbnails, larger ones first, then in the given order; of one path the first."""
    kept = F.filter(F.transform(urls, F.trim), lambda u: u.rlike("^https?://") & ~junk(u))
    ranked = F.array_sort(F.transform(kept, lambda u, i: F.struct((-area(u)).alias("a"), i.alias("i"), u.alias("u"), F.coalesce(F.try_parse_url(u, F.lit("PATH")), u).alias("path"))))

    def first(rows: Column, paths: Column) -> Column:
        return F.transform(F.filter(rows, lambda s, i: F.array_position(paths, s["path"]) == i + 1), lambda s: s["u"])

    both = one(ranked, lambda rows: F.struct(rows.alias("rows"), F.transform(rows, lambda s: s["path"]).alias("paths")))
    return one(both, lambda b: first(b["rows"], b["paths"]))


def full_size(url: Column) -> Column:
    """A thumbnail's address as the full picture's."""
    for small, large in (("thumbs", "uploads"), ("s", "l"), ("m", "l")):
        url = F.regexp_replace(url, f"(?i)^(.*?)/{small}/", f"$1/{large}/")
    return F.coalesce(url, F.lit(""))


def author_key(external: Column, name: Column) -> Column:
    """fb:<id> of an address with an id parameter, else host and path, else the plain identifier, else name:<words>."""
    raw = F.nullif(F.trim(external), F.lit(""))
    host = F.regexp_replace(F.lower(F.try_parse_url(raw, F.lit("HOST"))), r"^www\.", "")
    ident = F.nullif(F.regexp_extract(raw, r"[?&]id=([^&#]+)", 1), F.lit(""))
    of_url = F.coalesce(F.concat(F.lit("fb:"), F.lower(ident)), F.concat(host, F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(raw, F.lit("PATH")), F.lit("")), "/+$", ""))))
    words = F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", " ")), F.lit(""))
    return F.when(raw.isNotNull(), F.when(host.isNotNull(), of_url).otherwise(F.regexp_replace(F.lower(raw), r"\s+", " "))).otherwise(F.concat(F.lit("name:"), words))


def identifiers(c: Column) -> Column:
    """array<struct<type, value>> of what a text tells of contacts, codes and places: distinct, sorted by type and value."""
    every = lambda p: F.coalesce(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.array().cast("array<string>"))
    kinds = {
        "AGENCY_CODE": F.transform(every(AGENCY_CODE), F.upper),
        "EMAIL": F.transform(every(EMAIL), F.lower),
        "MAPS_PLACE_ID": every(PLACE),
        "MAPS_URL": every(MAPS),
        "PHONE": F.transform(every(PHONE), lambda x: T.phone_e164(x)),
        "PROPERTY_CODE": F.transform(every(PROPERTY_CODE), F.upper),
        "TELEGRAM": F.transform(F.concat(*map(every, TELEGRAM)), lambda x: F.concat(F.lit("@"), F.lower(x))),
        "WHATSAPP": F.transform(F.concat(*map(every, WHATSAPP)), lambda x: T.phone_e164(x)),
    }

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(F.array_compact(values), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("value")))

    return F.array_sort(F.array_distinct(F.concat(*[tagged(k, v) for k, v in kinds.items()])))


def contacts(c: Column) -> Column:
    """struct(phone, telegram, whatsapp, email): the first of each kind; a number named for a chat is not the phone unless it is the only one."""
    ids = identifiers(c)
    of = lambda kind: F.transform(F.filter(ids, lambda x: x["type"] == kind), lambda x: x["value"])
    phones, chats = of("PHONE"), of("WHATSAPP")
    own = F.array_except(phones, chats)
    return F.struct(F.coalesce(F.get(own, 0), F.get(phones, 0)).alias("phone"), F.get(of("TELEGRAM"), 0).alias("telegram"), F.get(chats, 0).alias("whatsapp"), F.get(of("EMAIL"), 0).alias("email"))


@F.pandas_udf(ArrayType(StringType()))
def nested_media(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Addresses of pictures anywhere in a JSON text: by their ending or by a key of their path. Sorted; none for a malformed text."""

    def walk(v: object, path: str, out: set) -> None:
        if isinstance(v, str):
            if re.search(r"https?://", v, re.I) and (re.search(IMAGE, v, re.I) or re.search("image|photo|media|attachment", path, re.I)):
                out.add(v.rstrip(".,;:!?)]}'\""))
        elif isinstance(v, (list, dict)):
            for k, x in v.items() if isinstance(v, dict) else (("", x) for x in v):
                walk(x, f"{path}.{k}", out)

    def one(text: str | None) -> list[str]:
        out: set = set()
        try:
            walk(json.loads(text or "null"), "", out)
        except ValueError:
            pass
        return sorted(out)

    for s in payloads:
        yield s.map(one)
