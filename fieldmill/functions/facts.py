"""Prices that texts state, and JSON of models and clients brought to bounds, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.rooms import one

# Words of tariffs and of rents, currencies, and how a month is written. Case-insensitive.
UTILITY = r"\b(?:electricity|water|utilities|utility|edc|kwh|m3|m³|person|pax)\b|ភ្លើង|ទឹក"
RENT = r"\b(?:rent(?:al)?|asking\s+price|price\s+for\s+rent|monthly\s+rate)\b|តម្លៃជួល|តំលៃជួល"
RENT_LABEL = r"(?:monthly\s+rent|rent(?:al)?\s+(?:price|rate)|asking\s+price|price\s+for\s+rent)"
UNIT = r"/\s*(?:kwh|m3|m³)|\bper\s+person\b|\b(?:person|pax)\b"
MONTH, ONE_MONTH = r"(?:/\s*(?:months?|mo)|per\s+month|monthly|ខែ)", r"(?:one\s+month|1\s+month|មួយ\s*ខែ)"
HOME_MONTH = r"/\s*(?:villa|house|room|apartment|flat|studio|shophouse|condo)\s+per\s+month"
KHMER_MONTH = r"/?\s*(?:ក្នុង\s*)?(?:1|១)\s*ខែ"
CURRENCY, AMOUNT = r"(USD|KHR|\$|៛)", r"([0-9](?>[0-9,]*)(?:\.[0-9]+)?+)"
INVISIBLE = r"[​-‍⁠﻿]"
#: Characters behind an amount in which a unit of a tariff counts; rents that are believed.
NEAR, RENTS = 36, (30, 100_000)


def rent_text(c: Column) -> Column:
    """A text without tariffs: amounts that a unit follows, and lines from a utility's name up to the next word for rent, are blanked."""
    c = F.regexp_replace(c, INVISIBLE, " ")
    c = F.regexp_replace(c, rf"(?iu){AMOUNT}\s*{CURRENCY}?[^\n]{{0,{NEAR}}}?(?:{UNIT})", " ; ")
    return F.regexp_replace(c, rf"(?iu)(?:{UTILITY})(?:(?!{RENT})[^\n])*", " ; ")


def _rate(c: Column, before: str, after: str, money_first: bool) -> Column:
    """struct(price, currency) of the first amount between two patterns that no tariff's unit follows."""
    money = rf"{CURRENCY}\s*{AMOUNT}" if money_first else rf"{AMOUNT}\s*{CURRENCY}"
    p = rf"(?iu){before}{money}{after}"
    number, sign = (2, 1) if money_first else (1, 2)
    price = F.regexp_replace(F.regexp_extract(c, p, number), ",", "").try_cast("double")
    code = F.upper(F.regexp_extract(c, p, sign))
    return F.when(price > 0, F.struct(price.alias("price"), F.when(code.isin("KHR", "៛"), "KHR").when(code.isin("USD", "$"), "USD").alias("currency")))


def source_price(c: Column) -> Column:
    """struct(price, currency) that a text asks for: labelled first, then by the month, then with a currency's code; null if none.

    The currency of a labelled amount may be missing. Amounts of utilities and amounts by person or unit are no prices.
    """
    return one(rent_text(c), _asked_price)


def _asked_price(c: Column) -> Column:
    label = rf"(?iu){RENT_LABEL}\s*[:|]?\s*{CURRENCY}?\s*{AMOUNT}"
    price, code = F.regexp_replace(F.regexp_extract(c, label, 2), ",", "").try_cast("double"), F.upper(F.regexp_extract(c, label, 1))
    labelled = F.when(price > 0, F.struct(price.alias("price"), F.when(code.isin("KHR", "៛"), "KHR").when(code.isin("USD", "$"), "USD").alias("currency")))
    rates = [("", rf"\s*{MONTH}", True), ("", rf"\s*{HOME_MONTH}", False), ("", rf"\s*{KHMER_MONTH}", False), ("", rf"\s*{MONTH}", False),
             (rf"{ONE_MONTH}\s*", "", False), (rf"{ONE_MONTH}\s*", "", True)]
    coded = F.regexp_replace(c, r"[$៛]", " ; ")
    return F.coalesce(labelled, *[_rate(c, *r) for r in rates], _rate(coded, r"\b", "", True))


def monthly_prices(c: Column) -> Column:
    """All distinct amounts of a text that are stated by the month or labelled as rent, within RENTS, sorted."""
    c = rent_text(c)
    labelled = rf"(?iu)(?:rent(?:al)?\s*(?:price)?|price\s*(?:for\s*)?rent|តម្លៃជួល|តំលៃជួល)\s*[:\-=]?\s*(?:USD\s*|\$\s*)?{AMOUNT}"
    monthly = rf"(?iu){AMOUNT}\s*(?:USD|\$|៛|KHR)?\s*(?:{MONTH}|{HOME_MONTH}|{KHMER_MONTH})"
    ahead = rf"(?iu){ONE_MONTH}\s*(?:USD|KHR|\$|៛)?\s*{AMOUNT}"
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in (labelled, monthly, ahead)])
    values = F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.between(*RENTS))))


def asking_prices(c: Column) -> Column:
    """Distinct amounts that are labelled as an asking price, within RENTS, sorted."""
    found = F.regexp_extract_all(rent_text(c), F.lit(rf"(?iu)\basking\s+price\s*[:：=]?\s*(?:USD|\$)\s*{AMOUNT}"), F.lit(1))
    values = F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x.between(*RENTS))))


class Payload:
    """Typed fields of a JSON text. A field of another type than asked for is null, and so are all of a text that is no object."""

    def __init__(self, text: Column):
        v = F.try_parse_json(text)
        self.ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        self.v = F.when(self.ok, v)

    def _raw(self, name: str) -> Column:
        return F.try_variant_get(self.v, f"$.{name}", "variant")

    def _is(self, name: str, pattern: str) -> Column:
        return F.schema_of_variant(self._raw(name)).rlike(f"^(?:{pattern})$")

    def string(self, name: str, most: int | None = None) -> Column:
        """A trimmed string, not blank, not the word null, of at most so many characters."""
        s = F.trim(F.when(self._is(name, "STRING"), F.try_variant_get(self.v, f"$.{name}", "string")))
        return F.when((s != "") & (F.lower(s) != "null") & ((F.length(s) <= most) if most else F.lit(True)), s)

    def number(self, name: str, least: float = 0, strict: bool = True) -> Column:
        x = F.when(self._is(name, r"BIGINT|DOUBLE|FLOAT|DECIMAL.*"), F.try_variant_get(self.v, f"$.{name}", "double"))
        return F.when((x > least) if strict else (x >= least), x)

    def integer(self, name: str, most: int) -> Column:
        x = self.number(name)
        return F.when((x == F.floor(x)) & (x <= most), x.cast("long"))

    def flag(self, name: str) -> Column:
        return F.when(self._is(name, "BOOLEAN"), F.try_variant_get(self.v, f"$.{name}", "boolean"))

    def one_of(self, name: str, *values: str) -> Column:
        s = F.when(self._is(name, "STRING"), F.try_variant_get(self.v, f"$.{name}", "string"))
        return F.when(s.isin(*values), s)

    def strings(self, name: str) -> Column:
        """The distinct strings of a list, trimmed, without blank ones and members of other types."""
        xs = F.try_variant_get(self.v, f"$.{name}", "array<variant>")
        text = F.transform(xs, lambda x: F.trim(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))))
        return F.coalesce(F.array_distinct(F.filter(text, lambda x: x != "")), F.array().cast("array<string>"))

    def whole_list(self, name: str, most: int, good) -> Column:
        """A list of at most `most` members if every one is good, else null: (value or null) = good(member, its type)."""
        xs = F.try_variant_get(self.v, f"$.{name}", "array<variant>")
        out = F.transform(xs, lambda x: good(x, F.schema_of_variant(x)))
        return F.when((F.size(xs) <= most) & ~F.exists(out, lambda x: x.isNull()), out)


#: Limits of what is kept of a search.
MOST_NUMBER, MOST_NAMES, MOST_COUNTS = 1_000_000, 20, 10


def search_context(c: Column) -> Column:
    """struct of the criteria of a search that are worth keeping; what is malformed or too long is null, by itself."""
    p = Payload(c)

    def name(x: Column, kind: Column) -> Column:
        s = F.trim(F.when(kind == "STRING", F.try_variant_get(x, "$", "string")))
        return F.when((s != "") & (F.length(s) <= 80), s)

    def count(x: Column, kind: Column) -> Column:
        n = F.when(kind == "BIGINT", F.try_variant_get(x, "$", "long"))
        return F.when((n > 0) & (n <= MOST_NUMBER), n)

    fields = {
        "city": p.string("city", 32), "category": p.string("category", 32), "type": p.one_of("type", "rent", "sale"), "query": p.string("query", 160),
        "sort": p.one_of("sort", "newest", "price_asc", "price_desc"), "locations": p.whole_list("locations", MOST_NAMES, name),
        "bedrooms": p.whole_list("bedrooms", MOST_COUNTS, count), "bathrooms": p.whole_list("bathrooms", MOST_COUNTS, count),
        "min_price": p.integer("minPrice", MOST_NUMBER), "max_price": p.integer("maxPrice", MOST_NUMBER), "min_lease_max": p.integer("minLeaseMax", MOST_NUMBER), "has_pool": p.flag("hasPool"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def iso_date(c: Column) -> Column:
    """A calendar day in the form yyyy-mm-dd; null for days that do not exist."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def demand_facts(c: Column, types: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """struct of a wish for housing from a model's JSON; null unless that is an object.

    Ranges are put in order. A budget that is approximate and one number is a target, never a hard range; without a target
    nothing is approximate, without a budget there is no currency. Property types are those given, in any case, or aliases.
    """
    p = Payload(c)
    pair = lambda a, b: (F.when(a > b, b).otherwise(a), F.when(a > b, a).otherwise(b))
    low, high = pair(p.number("budget_min"), p.number("budget_max"))
    about, target = F.coalesce(p.flag("budget_is_approximate"), F.lit(False)), p.number("budget_target")
    single = F.coalesce((low == high) & about & target.isNull(), F.lit(False))
    target = F.when(single, low).otherwise(target)
    low, high = F.when(~single, low), F.when(~single, high)
    months, beds = pair(p.number("duration_min_months"), p.number("duration_max_months")), pair(p.number("bedrooms_min", 0, False), p.number("bedrooms_max", 0, False))
    table = F.create_map(*[F.lit(x) for k, v in [*((t.lower(), t) for t in types), *aliases.items()] for x in (k, v)])
    fields = {
        "city": p.string("city"), "budget_min": low, "budget_max": high, "budget_target": target,
        "currency": F.when(F.coalesce(low, high, target).isNotNull(), p.one_of("currency", "USD", "KHR")), "approximate": about & target.isNotNull(),
        "move_in": iso_date(p.string("move_in_date")), "months_min": months[0], "months_max": months[1], "bedrooms_min": beds[0], "bedrooms_max": beds[1],
        "types": F.array_distinct(F.array_compact(F.transform(p.strings("property_types"), lambda x: table[F.lower(x)]))),
        "areas": p.strings("areas"), "must_haves": p.strings("must_haves"), "has_pets": p.flag("has_pets"), "people": p.integer("people_count", 1 << 31),
    }
    return F.when(p.ok, F.struct(*[v.alias(k) for k, v in fields.items()]))


def grounded(value: Column, c: Column, wording: str = "") -> Column:
    """A number that a model gives, if the text states it by itself (any thousands separators), with the wording behind it if one is given; else null."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(rf"(?iu)(?<![0-9.,]){AMOUNT}{wording}"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    return F.when(F.coalesce(F.array_contains(numbers, value.cast("double")), F.lit(False)), value)
