"""Areas and landmarks that texts name, against a gazetteer given as a parameter (some hundred entries, part of the plan)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.rooms import one


class Area(NamedTuple):
    """An area of a city. native: its name in the local script; official: whether it is an administrative unit of its own."""

    city: str
    name: str
    native: str = ""
    aliases: tuple[str, ...] = ()
    official: bool = True

    @property
    def key(self) -> str:
        return f"{self.city}:{self.name.lower().replace(' ', '_')}"


class Landmark(NamedTuple):
    ident: str
    city: str
    native: str = ""
    aliases: tuple[str, ...] = ()
    area: str | None = None


#: Letters that an alias needs before it may be found inside a longer address, and a landmark's before it counts at all.
INSIDE, LANDMARK = 4, 3


def plain(c: Column) -> Column:
    """Letters and digits of any script in lower case, single blanks between words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))


def _plain(text: str) -> str:
    return " ".join("".join(ch if ch.isalnum() else " " for ch in text.lower()).split())


def _first(rules: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(cond, F.lit(value)) for cond, value in rules], F.lit(None).cast("string"))


def official_area(c: Column, areas: list[Area], prefix: str = "") -> Column:
    """The key of the administrative area whose whole name a label is; a leading word such as "district" may be given as prefix."""
    return one(F.struct(plain(c).alias("plain"), F.trim(c).alias("c")), lambda p: _official(p["plain"], p["c"], areas, prefix))


def _official(label: Column, trimmed: Column, areas: list[Area], prefix: str) -> Column:
    label = F.regexp_replace(label, rf"^{prefix} ", "") if prefix else label
    return _first([(label.isin(*{_plain(x) for x in (a.name, *a.aliases)}) | (trimmed == a.native if a.native else F.lit(False)), a.key) for a in areas if a.official])


def find_area(c: Column, areas: list[Area], noise: tuple[str, ...] = (), prefix: str = "") -> Column:
    """The key of the area that an address or text names, else null.

    In this order: the whole label, the parts between commas from the first on without generic names (noise), a native name
    anywhere, a name or an alias of four letters or more anywhere. Parts that name two official areas contradict each other: null.
    """
    every = F.transform(F.split(c, r"\s*(?:[,/&]|\band\b)\s*"), lambda p: F.struct(plain(p).alias("plain"), F.trim(p).alias("c")))
    parts = F.filter(every, lambda p: ~p["plain"].isin("", *[_plain(x) for x in noise]))
    given = F.struct(c.alias("c"), F.trim(c).alias("trimmed"), plain(c).alias("plain"), parts.alias("parts"))

    def named(x: Column) -> Column:
        keys = F.array_distinct(F.array_compact(F.transform(x["parts"], lambda p: _official(p["plain"], p["c"], areas, prefix))))
        return one(keys, lambda k: F.when(F.size(k) <= 1, F.coalesce(_official(x["plain"], x["trimmed"], areas, prefix), F.get(k, 0), _inside(x, areas))))

    return F.when(c.isNotNull(), one(given, named))


def _inside(x: Column, areas: list[Area]) -> Column:
    """The area whose native name, whole alias in a part, or longer alias anywhere a text has. x: c, plain, parts."""
    spaced = F.concat(F.lit(" "), x["plain"], F.lit(" "))
    native = _first([(F.contains(x["c"], F.lit(a.native)), a.key) for a in areas if a.native])
    alias = lambda p: _first([(p["plain"].isin(*{_plain(y) for y in (a.name, *a.aliases)}), a.key) for a in areas])
    by_part = F.get(F.array_compact(F.transform(x["parts"], alias)), 0)
    inside = _first([(F.contains(spaced, F.lit(y)), a.key) for a in areas for y in [_plain(a.name), *(_plain(z) for z in a.aliases if len(_plain(z)) >= INSIDE)]])
    return F.coalesce(native, by_part, inside)


def area_key(fields: list[Column], city: Column, areas: list[Area], prefix: str = "") -> Column:
    """The key of the first field that names an official area of the record's city; null for other cities and without one."""
    cities = sorted({a.city for a in areas})
    return F.coalesce(*[F.when(city == x, F.coalesce(*[official_area(f, [a for a in areas if a.city == x], prefix) for f in fields])) for x in cities])


def search_names(names: list[str], areas: list[Area], prefix: str = "District") -> list[str]:
    """Names that a search for areas stands for: each as given, and of known ones the name, its long form and all aliases; each once."""
    known = {_plain(x): a for a in reversed(areas) for x in (a.name, *a.aliases)}
    out: dict[str, None] = {}
    for raw in filter(None, (n.strip() for n in names)):
        a = known.get(_plain(raw))
        out |= dict.fromkeys([raw] if a is None else [raw, a.name, f"{prefix} {a.name}", *a.aliases])
    return list(out)


def landmarks(c: Column, marks: list[Landmark], city: str | None = None) -> Column:
    """Identifiers of the landmarks that a text names, in the order of the table: a native name anywhere or an alias as whole words."""
    return one(F.struct(c.alias("c"), F.concat(F.lit(" "), plain(c), F.lit(" ")).alias("spaced")), lambda x: _named(x["c"], x["spaced"], marks, city))


def _named(c: Column, spaced: Column, marks: list[Landmark], city: str | None) -> Column:
    def named(m: Landmark) -> Column:
        out = F.contains(c, F.lit(m.native)) if m.native else F.lit(False)
        for a in map(_plain, m.aliases):
            out = out | F.contains(spaced, F.lit(f" {a} ")) if len(a) >= LANDMARK else out
        return out

    chosen = [m for m in marks if city in (None, m.city)]
    return F.array_compact(F.array(*[F.when(named(m), F.lit(m.ident)) for m in chosen]).cast("array<string>"))


def of_landmarks(found: Column, marks: list[Landmark]) -> Column:
    """struct(area, city) from landmarks: the area of the first one that has one; the city only if all lie in the same."""
    area = F.create_map(*[F.lit(x) for m in marks if m.area for x in (m.ident, m.area)]) if any(m.area for m in marks) else F.create_map().cast("map<string,string>")
    town = F.create_map(*[F.lit(x) for m in marks for x in (m.ident, m.city)])
    towns = F.array_distinct(F.transform(found, lambda x: town[x]))
    return F.struct(F.get(F.array_compact(F.transform(found, lambda x: area[x])), 0).alias("area"), F.when(F.size(towns) == 1, F.get(towns, 0)).alias("city"))
