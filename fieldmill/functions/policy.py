"""What may stand of the facts that a model gives for an advert: the author's words decide, then the platform's form, then the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions import rooms
from fieldmill.functions.rooms import one

# Kinds of property with their category, and the words of a heading that name them.
CATEGORY = {"Condo": "apartment", "Apartment": "apartment", "Studio": "apartment", "Room": "room", "Private Villa": "house", "Private House": "house", "Flat House": "house", "Hotel Room": "hotel"}
HEADINGS = {"Condo": r"condo(?:minium)?", "Apartment": "apartment", "Studio": "studio", "Private Villa": "villa", "Private House": r"(?:private\s+)?house", "Flat House": r"(?:shophouse|flat\s+house)"}
#: Kinds that the body of a text supports by the same words as a heading.
IN_BODY = ("Private Villa", "Private House", "Apartment", "Condo")
# Wordings by which a source supports an amenity; others need none.
AMENITIES = {
    "air_conditioner": r"\b(?:a\s*\/\s*c|air[ -]?condition(?:er|ing)|ac)\b",
    "ac_all_rooms": r"\b(?:ac|a\s*\/\s*c|air[ -]?condition(?:er|ing))\b\s*(?:in\s+)?(?:all|every)\s+(?:the\s+)?rooms?\b|\b(?:all|every)\s+(?:the\s+)?rooms?\b[^.!?\n]{0,55}\b(?:ac|a\s*\/\s*c|air[ -]?condition(?:er|ing))\b|\bair[ -]?condition(?:ed|ing)\s+throughout\b",
    "car_parking": r"\b(?:car\s+park(?:ing)?|park(?:ing)?\s+(?:for\s+)?cars?)\b",
    "motorbike_parking": r"\b(?:motor\s*cycle|motor\s*bike|scooter|moto)\s+park(?:ing)?\b|\bpark(?:ing)?\s+(?:for\s+)?(?:motor\s*cycle|motor\s*bike|scooter|moto)s?\b",
    "free_wifi": r"\b(?:free|included|complimentary)\s+(?:wi[ -]?fi|wifi)\b|\b(?:wi[ -]?fi|wifi)\s*(?:is\s+)?(?:included|free|complimentary)\b",
    "hot_water_heater": r"\b(?:hot\s+water|water\s+heater|hot\s+shower)\b|ទឹកក្តៅ",
    "refrigerator": r"\b(?:refrigerator|fridge|freezer)\b|ទូទឹកកក",
    "washing_machine": r"\b(?:washing\s+machine|laundry\s+machine|washer)\b|ម៉ាស៊ីនបោកខោអាវ",
    "western_kitchen": r"\b(?:western|european)[\s-]+(?:style[\s-]+)?kitchen\b|\bkitchen\s+(?:of\s+)?(?:western|european)[\s-]+style\b",
}
HEATER = r"(?i)(?<!\w)(?:hot (?:and )?water heater|water heater|hot water)(?!\w)"
#: Characters of a first line that is still a heading.
HEADING = 160

AMOUNT = r"[0-9][0-9,]*(?:\.[0-9]+)?"
RENT = rf"(?i)(?<!\w)(rental price|monthly rent|rent|price) ?[:：=]? ?(\$|usd|khr)? ?({AMOUNT}) ?(usd|khr)?(?!\w) ?((?:/ ?|per )?(?:monthly|month|mo)(?!\w))?"
UTILITY = r"(?i)(?<!\w)(?:water|electricity|power|utility|utilities|trash|garbage|cleaning|deposit)(?: service| utility)? price(?!\w)"
MONEY = rf"(?:\$\s*{AMOUNT}|usd\s*{AMOUNT}|{AMOUNT}\s*(?:usd(?!\w)|\$))"
DEPOSIT = r"(?:(?<!\w)(?:security\s+)?deposit(?!\w)|ប្រាក់កក់|កក់)"
BEHIND = rf"\s*(?:amount\s*)?[:：=-]?\s*{MONEY}"


def _value(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, f"({AMOUNT})", 1), ",", "").try_cast("double")


def monthly_rent(text: Column) -> Column:
    """struct(kind, price, currency) of a rent that the author calls monthly: confirmed, conflict (several differ) or unknown.

    A sum with the currency before it needs a month behind it; one with the currency behind it needs "per month" or the
    label "monthly rent". Prices of utilities and deposits are none.
    """

    def rent(m: Column) -> Column:
        label, before, behind, per = (F.lower(F.regexp_extract(m, RENT, i)) for i in (1, 2, 4, 5))
        ok = F.when(before != "", per != "").otherwise((behind != "") & ((label == "monthly rent") | per.rlike("^(/|per )")))
        currency = F.when(F.coalesce(F.nullif(before, F.lit("")), behind) == "khr", "KHR").otherwise("USD")
        value = F.regexp_replace(F.regexp_extract(m, RENT, 3), ",", "").try_cast("double")
        return F.when(ok & (value > 0), F.struct(value.alias("price"), currency.alias("currency")))

    clauses = F.transform(F.split(text, r"[;\r\n]+|(?<=[.!?])\s+"), lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), UTILITY, " "))
    found = F.flatten(F.transform(clauses, lambda c: F.transform(F.regexp_extract_all(c, F.lit(RENT), F.lit(0)), rent)))

    def settled(v: Column) -> Column:
        kind = F.when(F.size(v) > 1, "conflict").when(F.size(v) == 1, "confirmed").otherwise("unknown")
        first = F.when(F.size(v) == 1, F.get(v, F.lit(0)))
        return F.struct(kind.alias("kind"), first["price"].alias("price"), first["currency"].alias("currency"))

    return one(F.array_distinct(F.array_compact(found)), settled)


def deposit_amount(text: Column) -> Column:
    """The one sum in dollars that stands at a deposit's name, behind it or, if no rent is named there, before it; else null."""
    lines = F.split(text, r"[\r\n;]+")
    before = rf"([^\r\n;]{{0,24}}?)({MONEY})\s*{DEPOSIT}(?!{BEHIND})"

    def of(line: Column) -> Column:
        behind = F.transform(F.regexp_extract_all(line, F.lit(f"(?i){DEPOSIT}({BEHIND})"), F.lit(1)), _value)
        ahead = F.transform(F.regexp_extract_all(line, F.lit("(?i)" + before), F.lit(0)), lambda m: F.when(~F.regexp_extract(m, "(?i)" + before, 1).rlike(r"(?i)(?<!\w)(?:rent(?:al)?|price|per\s+month|monthly)(?!\w)"), _value(F.regexp_extract(m, "(?i)" + before, 2))))
        return F.concat(behind, ahead)

    sums = F.array_distinct(F.filter(F.flatten(F.transform(lines, of)), lambda x: x > 0))
    return one(sums, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def amenities(named: Column, text: Column, known: list[str]) -> Column:
    """The known amenities of a model's list that the source supports; air conditioning in all rooms stands for the plain one."""
    supported = F.array_compact(F.array(*[F.when(text.rlike("(?i)" + AMENITIES[a]) if a in AMENITIES else F.lit(True), F.lit(a)) for a in known]))
    kept = F.filter(F.coalesce(named, F.array().cast("array<string>")), lambda x: F.array_contains(supported, x))
    return one(kept, lambda v: F.when(F.array_contains(v, "ac_all_rooms"), F.array_remove(v, "air_conditioner")).otherwise(v))


def _word(pattern: str) -> str:
    return rf"(?i)(?<!\w){pattern}(?!\w)"


def property_type(model: Column, text: Column) -> Column:
    """struct(type, overridden): the model's kind unless the heading names one other category and the body does not support the model's; without a model's kind the heading's."""
    lines = F.split(F.trim(text), r"\r?\n")
    heading = F.get(lines, F.lit(0))
    named = F.array_compact(F.array(*[F.when(heading.rlike(_word(p)), F.lit(k)) for k, p in HEADINGS.items()]))
    by_heading = F.when((F.length(heading) <= HEADING) & (F.size(named) == 1), F.get(named, F.lit(0)))
    kinds = F.create_map(*[F.lit(x) for k in CATEGORY for x in (k.lower(), k)])
    category = F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])
    body = F.array_join(F.slice(F.split(text, r"\r?\n"), F.lit(2), F.greatest(F.size(F.split(text, r"\r?\n")) - 1, F.lit(0))), "\n")
    own = F.get(F.array(kinds[F.lower(model)]), F.lit(0))
    backed = F.lit(False)
    for k in IN_BODY:
        backed = backed | ((F.lower(model) == k.lower()) & body.rlike(_word(HEADINGS[k])))
    over = F.coalesce((category[by_heading] != category[own]) & ~backed, F.lit(False))
    kind = F.when(over, by_heading).otherwise(F.coalesce(own, by_heading))
    return F.struct(kind.alias("type"), over.alias("overridden"))


def category_of(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CATEGORY.items() for x in kv])[kind]


def tidy(text: Column) -> Column:
    """A text after claims went out of it: single blanks, none before marks, no doubled marks, no empty brackets."""
    for pattern, new in ((r"[ \t]{2,}", " "), (r"\s+([,.;:!?])", "$1"), (r"([,;:])\s*([,;:])+", "$2"), (r"\(\s*\)", "")):
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def _claims(text: Column, beds: Column, baths: Column) -> Column:
    return tidy(rooms.claims_kept(rooms.claims_kept(text, "bed", beds), "bath", baths))


def description(text: Column, source: Column, beds: Column, baths: Column) -> Column:
    """A generated description: only verified counts, no heater that the source does not name, no sentence that lost its object."""
    text = F.when(source.rlike("(?i)" + AMENITIES["hot_water_heater"]), text).otherwise(F.regexp_replace(text, HEATER, ""))
    sentences = F.transform(F.split(text, r"(?<=[.!?])\s+|\r?\n+"), lambda s: _claims(s, beds, baths))
    kept = F.filter(sentences, lambda s: (s != "") & ~s.rlike(r"(?i)(?<!\w)(?:has|with|including|features?)\s*[,.;:]?\s*$"))
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s{2,}", " "))


def grounded_facts(model: Column, source: Column, platform: Column, known_amenities: list[str]) -> Column:
    """A model's facts as far as the source supports them.

    model: struct(title, description, price double, currency, bedrooms int, bathrooms int, property_type, category,
    amenities array<string>); platform: struct(bedrooms int, bathrooms int) of the form. Rent: the author's monthly sum, null
    if several differ, else the model's. Rooms: the author's count, null in conflict, else the form's where the model
    says the same. Category follows the kind of property. A null model gives null; a null source states nothing.
    """
    given = F.struct(F.coalesce(source, F.lit("")).alias("source"), model.alias("model"), platform.alias("platform"))
    return one(given, lambda x: F.when(x["model"].isNotNull(), _grounded(x["model"], x["source"], x["platform"], known_amenities)))


def _grounded(model: Column, source: Column, platform: Column, known_amenities: list[str]) -> Column:

    def counted(said: Column) -> Column:
        def of(kind: str) -> Column:
            form = platform[kind]
            agreed = F.when(form.between(0, rooms.MOST) & (model[kind] == form), form)
            return F.when(~said[f"{kind}_conflict"], F.coalesce(said[kind], agreed)).cast("int")

        return F.struct(of("bedrooms").alias("bedrooms"), of("bathrooms").alias("bathrooms"))

    def facts(x: Column) -> Column:
        beds, baths, rent, kind = x["n"]["bedrooms"], x["n"]["bathrooms"], x["rent"], x["kind"]["type"]
        free = rent["kind"] == "unknown"
        price = F.when(free, F.when(model["price"] > 0, model["price"])).otherwise(rent["price"])
        currency = F.when(free, F.when(model["currency"].isin("USD", "KHR"), model["currency"])).otherwise(rent["currency"])
        renamed = lambda t: F.when(x["kind"]["overridden"] & (kind == "Apartment"), F.regexp_replace(t, r"(?i)(?<!\w)(?:private\s+)?house(?!\w)", "apartment")).otherwise(t)
        declared = F.lower(model["category"])
        return F.struct(
            renamed(_claims(F.coalesce(model["title"], F.lit("")), beds, baths)).alias("title"),
            renamed(description(F.coalesce(model["description"], F.lit("")), source, beds, baths)).alias("description"),
            price.alias("price"), F.when(price.isNotNull(), currency).alias("currency"), beds.alias("bedrooms"), baths.alias("bathrooms"), kind.alias("property_type"),
            F.coalesce(category_of(kind), F.when(kind.isNull() & declared.isin(*sorted(set(CATEGORY.values())), "land"), declared)).alias("category"),
            deposit_amount(source).alias("deposit"), amenities(model["amenities"], source, known_amenities).alias("amenities"),
        )

    parts = one(rooms.room_counts(source), lambda said: F.struct(counted(said).alias("n"), monthly_rent(source).alias("rent"), property_type(model["property_type"], source).alias("kind")))
    return one(parts, facts)
