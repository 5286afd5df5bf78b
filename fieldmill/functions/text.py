"""Text functions as columns. Patterns use explicit ASCII classes, so that they mean the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_html(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return collapse(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"&[A-Za-z#0-9]+;", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\f]+", " "))


def normalise_repost(c: Column) -> Column:
    """Lower case, without addresses of sites, mail, phones and handles, and without marks. Mail and handles are not looked for in a text without an at sign."""
    cut = lambda x, pattern: F.regexp_replace(x, pattern, " ")
    site, phone, marks = r"https?://[^ \n]+", r"\+?[0-9][0-9() .-]{6,}[0-9]", r"[^\p{L}\p{N}]+"
    low = F.lower(c)
    every = cut(cut(cut(cut(cut(low, site), r"[a-z0-9._%+-]+@[a-z0-9.-]+"), phone), r"@[a-z0-9_]+"), marks)
    return F.trim(F.when(F.contains(c, F.lit("@")), every).otherwise(cut(cut(cut(low, site), phone), marks)))


#: Words that carry no signal for reposts.
STOP_WORDS = ("a", "an", "and", "at", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with")


def tokens(c: Column) -> Column:
    """Distinct words of a normalised text, of two characters or with a digit, without stop words."""
    keep = lambda w: ((F.length(w) >= 2) | w.rlike("[0-9]")) & ~w.isin(*STOP_WORDS)
    return F.array_distinct(F.filter(F.split(c, " "), keep))


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters, or a shorter text itself.

    They are looked up ahead from each place; as that is one of UTF-16, a text beyond the basic plane is cut into characters once instead.
    """
    n = F.length(c)
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 3, F.lit(0))), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)))
    split = F.flatten(F.transform(F.array(F.split(c, "")), runs))
    every = F.when(c.rlike(r"[^\x{0}-\x{ffff}]"), split).otherwise(F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), F.lit(1)))
    return F.when(n < 3, F.when(n > 0, F.array(c)).otherwise(F.array().cast("array<string>"))).otherwise(F.array_distinct(every))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(F.array_union(a, b)) > 0, both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n > 0, 2.0 * F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def similarity(tokens_a: Column, tokens_b: Column, grams_a: Column, grams_b: Column) -> Column:
    return 0.7 * jaccard(tokens_a, tokens_b) + 0.3 * dice(grams_a, grams_b)


def canonical_url(c: Column) -> Column:
    """https, no www. or m., no fragment, no tracking parameters, other parameters sorted, no final slash; null for what is not a web address."""
    host = F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z]+://([^/?#]+)", 1)), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|fbclid|gclid|ref)=")))
    return F.when(c.rlike(r"^https?://[^/?#]+"), F.concat(F.lit("https://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_e164(c: Column, country: str = "855") -> Column:
    """+country and the subscriber's digits; null unless 8 or 9 digits follow a national 0, or the country code."""
    d = digits(c)
    own = F.when(F.startswith(d, F.lit("00" + country)), F.substring(d, len(country) + 3, 20)).when(F.startswith(d, F.lit(country)), F.substring(d, len(country) + 1, 20)).when(F.startswith(d, F.lit("0")), F.substring(d, 2, 20))
    own = F.regexp_replace(own, "^0+", "")
    return F.when(F.length(own).between(8, 9), F.concat(F.lit("+" + country), own))


def price_cents(c: Column, riel_per_dollar: int = 4000) -> Column:
    """The first amount of a text in US cents: $1,200.50, 850 USD, 1.2k$, or riel at a fixed rate; null if there is none."""
    number = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
    dollars = F.coalesce(
        F.nullif(F.regexp_extract(c, r"\$ ?" + number, 1), F.lit("")),
        F.nullif(F.regexp_extract(c, r"(?i)" + number + r" ?(?:usd|dollars?|\$)", 1), F.lit("")),
    )
    riel = F.nullif(F.regexp_extract(c, r"(?i)" + number + r" ?(?:khr|riels?)", 1), F.lit(""))
    thousands = F.when(c.rlike(r"(?i)\$ ?[0-9][0-9,.]*k|[0-9]k ?(\$|usd)"), 1000).otherwise(1)
    kilo = F.nullif(F.regexp_extract(c, r"(?i)" + number + r"k ?(?:usd|\$)", 1), F.lit(""))
    value = lambda x: F.regexp_replace(x, ",", "").try_cast("double")
    return F.coalesce(F.round(value(F.coalesce(dollars, kilo)) * 100 * thousands), F.round(value(riel) * 100 / riel_per_dollar)).cast("long")


#: Number words.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


BEDS, BATHS = "bed ?rooms?|brs?|beds?", "bath ?rooms?|baths?"


def room_values(c: Column, unit: str) -> Column:
    """The distinct numbers before a unit's word; more than one is a conflict."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"([0-9]{{1,2}}|{'|'.join(NUMBERS)})[ -]?(?:{unit})"), F.lit(1))
    words = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    return F.array_distinct(F.transform(found, lambda x: F.coalesce(x.try_cast("int"), words[x])))


def room_count(c: Column, unit: str) -> Column:
    """The number before a unit's word if all mentions agree, else null."""
    values = room_values(c, unit)
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def bedrooms(c: Column) -> Column:
    return room_count(c, BEDS)


def bathrooms(c: Column) -> Column:
    return room_count(c, BATHS)


def has_pool(c: Column) -> Column:
    """True, false or null: a text that says neither is unknown."""
    c = F.lower(c)
    return F.when(c.rlike(r"(no|without( a)?) (swimming )?pool"), False).when(c.rlike(r"(swimming pool|with pool|pool view|private pool)"), True)


def language(c: Column) -> Column:
    """khmer, cyrillic, latin, mixed or unknown, by the share of letters of each script."""
    n = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    share = lambda script: F.length(F.regexp_replace(c, rf"[^\p{{{script}}}]", "")) / F.greatest(n, F.lit(1))
    return F.when(n == 0, "unknown").when(share("IsKhmer") > 0.6, "khmer").when(share("IsCyrillic") > 0.6, "cyrillic").when(share("IsLatin") > 0.6, "latin").otherwise("mixed")


def relative_seconds(c: Column) -> Column:
    """Age in seconds of "3h", "2 days ago", "5 mins", "just now"; null for other texts."""
    n = F.regexp_extract(F.lower(c), r"([0-9]+) ?(s|m|h|d|w|min|hour|hr|day|week)", 1).try_cast("long")
    unit = F.regexp_extract(F.lower(c), r"[0-9]+ ?([a-z]+)", 1)
    size = F.when(unit.rlike("^(s|secs?|seconds?)$"), 1).when(unit.rlike("^(m|mins?|minutes?)$"), 60).when(unit.rlike("^(h|hrs?|hours?)$"), 3600).when(unit.rlike("^(d|days?)$"), 86400).when(unit.rlike("^(w|weeks?)$"), 604800)
    return F.when(F.lower(c).rlike("just now"), F.lit(0).cast("long")).otherwise(n * size)


def budget(c: Column) -> Column:
    """struct(low, high) in dollars of "200-400", "under 500", "from 300", "200+" or "450" (a cap)."""
    c = F.regexp_replace(F.lower(c), "[$, ]", "")
    a, b = (F.regexp_extract(c, r"([0-9]+)(?:-|to)([0-9]+)", i).try_cast("long") for i in (1, 2))
    one = F.regexp_extract(c, r"([0-9]+)", 1).try_cast("long")
    floor_ = c.rlike(r"^(from|over|above|min)|[0-9]\+")
    low = F.when(b.isNotNull(), F.least(a, b)).when(floor_, one)
    high = F.when(b.isNotNull(), F.greatest(a, b)).when(~floor_, one)
    return F.struct(low.alias("low"), high.alias("high"))


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def head_tail(c: Column, head: int, tail: int) -> Column:
    """A long text as its head and tail."""
    return F.when(F.length(c) > head + tail, F.concat(F.substring(c, 1, head), F.lit("\n...\n"), F.substring(c, -tail, tail))).otherwise(c)


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
