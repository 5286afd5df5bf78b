"""Counts of rooms that an advert states by itself: fields, conflicts, compounds and components, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words in order, and the nouns of both kinds of rooms.
WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
LATIN = {"bed": r"bed\s*rooms?|br", "bath": r"bath\s*rooms?|baths?"}
KHMER = {"bed": "បន្ទប់គេង", "bath": "បន្ទប់ទឹក"}
STUDIO = r"(?i)(?<!\w)studio(?!\w)|ស្ទូឌីយោ"
#: What a line of components names, what shows a floor plan, and furniture that is counted like beds.
COMPONENT = r"(?i)(?<!\w)\d+\s*[-–]?\s*(?:wood(?:en)?\s+house|(?:separate\s+)?(?:units?|rooms?|bungalows?|houses?|villas?|suites?))(?!\w)|(?<!\w)(?:each|per\s+(?:unit|room|house|villa|bungalow|suite))(?!\w)"
PLAN = r"(?i)(?<!\w)(?:layout|floor[ \t]+plan|configuration)[ \t]*[:：=-](.*)$"
FURNITURE = r"(?:frames?|mattresses?|sheets?|linen|covers?|sofas?|sets?|included|provided)"
#: Rooms of a kind that one advert can have.
MOST = 30

VALUES = {w: i for i, w in enumerate(WORDS)} | {f"twenty {w}": 20 + i for i, w in enumerate(WORDS[1:10], 1)}
NUMBER = rf"(?:[0-9]{{1,2}}|twenty[ -](?:{'|'.join(WORDS[1:10])})(?!\w)|{'|'.join(sorted(WORDS, key=len, reverse=True))})"
NOUN = {k: rf"(?:(?:{LATIN[k]})(?!\w)|{KHMER[k]})" for k in LATIN}
ANY = rf"(?:{NOUN['bed']}|{NOUN['bath']})"
#: A field: the number and then the noun, or the noun and then the number, whichever starts first; so no number serves two fields.
FIELD = rf"(?i)(?<!\w){NUMBER}[ \t]*[-–]?[ \t]*{ANY}|(?<!\w)(?:{ANY}(?:[ \t]*[:：=-][ \t]*|[ \t]+)|(?:{KHMER['bed']}|{KHMER['bath']}))(?:{NUMBER})(?!\w)"


def one(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain(text: Column) -> Column:
    """The text with Khmer digits as ASCII ones and marks without width as spaces."""
    digits = "".join(chr(0x17E0 + i) for i in range(10))
    return F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), "[\u200b-\u200d\ufeff]", " "), digits, "0123456789")


def number(mention: Column) -> Column:
    """The number that a mention holds, in digits or words; null beyond MOST."""
    words = F.create_map(*[F.lit(x) for kv in VALUES.items() for x in kv])
    found = F.lower(F.regexp_extract(mention, rf"(?i)({NUMBER})", 1))
    value = F.coalesce(found.try_cast("int"), F.get(F.array(words[F.regexp_replace(found, "-", " ")]), F.lit(0)))
    return F.when(value <= MOST, value)


def _numbers(mentions: Column) -> Column:
    return F.array_compact(F.transform(mentions, number))


def _fields(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(FIELD), F.lit(0))
    return _numbers(F.filter(found, lambda m: m.rlike("(?i)" + NOUN[kind])))


def _planned(lines: Column) -> Column:
    """Numbers before "bed" in a floor plan, or paired with baths; not of furniture."""
    bed = rf"(?i)(?<!\w){NUMBER}[ \t]*[-–]?[ \t]*bed(?!\w)"
    paired = bed + r"(?=[ \t]*[|,;/&][ \t]*\d{1,2}[ \t]*[-–]?[ \t]*baths?(?!\w))"
    plan = lambda x: F.regexp_extract_all(F.regexp_extract(x, PLAN, 1), F.lit(bed + rf"(?![ \t]*(?:[-–][ \t]*)?{FURNITURE}(?!\w))"), F.lit(0))
    return _numbers(F.flatten(F.transform(lines, lambda x: F.concat(F.regexp_extract_all(x, F.lit(paired), F.lit(0)), plan(x)))))


def _compound(text: Column, kind: str) -> Column:
    """Whether a sum such as "4 + 1" stands at the noun: a mix of rooms that gives no count."""
    total = r"\d{1,2}\s*\+\s*\d{1,2}"
    forms = rf"(?<!\w)(?:{LATIN[kind]})\s*[:：=-]\s*{total}(?!\w)|(?<!\w){total}\s*{NOUN[kind]}|{KHMER[kind]}\s*[:：=-]?\s*{total}"
    return text.rlike("(?i)" + forms)


def _villa(text: Column) -> Column:
    """The total of a compound whose main and additional bedrooms, each named once, add up to the one total that the rest of the text states."""
    main, extra = r"(?<!\w)(?:main|primary)[ \t]+\d{1,2}[ \t]*[-–]?[ \t]*bed\s*rooms?(?!\w)", r"(?<!\w)\d{1,2}[ \t]+(?:additional|extra)[ \t]+bed\s*rooms?(?!\w)"
    parts = lambda form: F.regexp_extract_all(text, F.lit("(?i)" + form), F.lit(0))
    total = number(F.get(parts(main), F.lit(0))) + number(F.get(parts(extra), F.lit(0)))
    rest = F.array_distinct(_fields(F.regexp_replace(text, f"(?i){main}|{extra}", "\n"), "bed"))
    return F.when((F.size(parts(main)) == 1) & (F.size(parts(extra)) == 1) & (total > 0) & (total <= MOST) & (F.size(rest) == 1) & (F.get(rest, F.lit(0)) == total), total)


def room_counts(text: Column) -> Column:
    """struct(bedrooms, bathrooms, bedrooms_conflict, bathrooms_conflict) of an advert's own words.

    A count is null where the text states none, states several, or writes a sum; the last two are conflicts. Bathrooms
    of components ("each", "6-unit rooms") are not the property's; a studio has no bedroom of its own. A null text states
    nothing. Furniture ("2 beds") is not counted but in a floor plan.
    """

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(COMPONENT))
        beds = F.array_distinct(F.concat(_fields(t, "bed"), _planned(lines)))
        baths = F.array_distinct(_fields(F.array_join(lines, "\n"), "bath"))
        return one(F.struct(beds.alias("beds"), baths.alias("baths")), lambda v: settled(t, v["beds"], v["baths"]))

    def settled(t: Column, beds: Column, baths: Column) -> Column:
        several, sum_ = F.size(beds) > 1, _compound(t, "bed")
        villa = F.when(several & ~sum_, _villa(t))
        bed_conflict = (several | sum_) & villa.isNull()
        bath_conflict = (F.size(baths) > 1) | _compound(t, "bath")
        bed = F.coalesce(villa, F.when(~bed_conflict, F.coalesce(F.get(beds, F.lit(0)), F.when(t.rlike(STUDIO), 0))))
        return F.struct(bed.alias("bedrooms"), F.when(~bath_conflict, F.get(baths, F.lit(0))).alias("bathrooms"), bed_conflict.alias("bedrooms_conflict"), bath_conflict.alias("bathrooms_conflict"))

    return one(plain(text), of)


def claims_kept(text: Column, kind: str, count: Column) -> Column:
    """A generated text whose claims of rooms have the verified count; without one the claims go."""
    noun = NOUN[kind] if kind == "bed" else rf"(?:(?:{LATIN[kind]}|ba)(?!\w)|{KHMER[kind]})"
    claim = rf"(?i)(?<!\w){NUMBER}([ \t]*[-–]?[ \t]*{noun})|(?<!\w)({noun}[ \t]*[:：=-]?[ \t]*){NUMBER}(?!\w)"
    return F.regexp_replace(text, F.lit(claim), F.when(count.isNull(), "").otherwise(F.concat(F.lit("$2"), count.cast("string"), F.lit("$1"))))
