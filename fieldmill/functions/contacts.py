"""Whom to call and whom to write to: numbers of an advert by what its words say they are for, and the forms of numbers, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.rooms import one
from fieldmill.functions.text import digits

# How numbers and handles are written, the words for chats and calls, names that are no handles, and where a line's items part.
PHONE = r"(?:\+?855|0)[1-9]\d{1,2}[\s.-]?\d{3}[\s.-]?\d{3,4}"
TELEGRAM = r"(?i)(?:telegram|tg)(?!\w)|តេឡេក្រាម"
WHATSAPP = r"(?i)(?:whatsapp|whats\s*app|wa)(?!\w)"
CALL = r"(?i)(?:tel|call|phone|mobile|cellcard|smart|metfone|contact)(?!\w)|ទូរស័ព្ទ|ទំនាក់ទំនង"
BEHIND = {"telegram": r"telegram|tg|t\.me", "whatsapp": "whatsapp|wa", "call": "call|tel|phone|voice"}
LINKS = {"telegram": r"(?i)https?://t\.me/([a-zA-Z0-9_+]+)", "whatsapp": r"(?i)https?://wa\.me/([0-9+]+)"}
NO_HANDLE, NO_HANDLE_ANYWHERE = ("gmail", "yahoo", "hotmail"), ("gmail", "hotmail", "yahoo", "facebook", "khmer24", "channel")
ITEMS = r"\s*[/|]\s*(?=[A-Za-z\x{1780}-\x{17FF}]+[:：]|\+?855|0\d)"
LISTED = r"[/,|\n]+"


def subscriber(c: Column, country: str = "855") -> Column:
    """A number's digits without the country's code or the national 0; null below seven."""
    own = one(digits(c), lambda d: F.when(F.length(d) < 7, "").when(F.startswith(d, F.lit(country)), F.substring(d, len(country) + 1, 99)).when(F.startswith(d, F.lit("0")), F.substring(d, 2, 99)).otherwise(d))
    return one(own, lambda x: F.when(F.length(x) >= 7, x))


def _grouped(c: Column) -> Column:
    return F.when(F.length(c) <= 9, F.concat(F.substring(c, 1, 2), F.lit(" "), F.substring(c, 3, 3), F.lit(" "), F.substring(c, 6, 9))).otherwise(c)


def _domestic(c: Column) -> Column:
    return one(subscriber(c), lambda x: F.concat(F.lit("0"), _grouped(x)))


def _international(c: Column) -> Column:
    return one(subscriber(c), lambda x: F.concat(F.lit("+855 "), _grouped(x)))


def formatted(c: Column, style: str = "domestic") -> Column:
    """One number, or several between / , | or line ends, as 0XX XXX XXX (domestic), +855 XX XXX XXX (international) or both, joined by " / "; null where there is none."""
    parts = F.filter(F.transform(F.split(c, LISTED), lambda x: F.trim(x)), lambda x: x != "")

    def form(x: Column) -> Column:
        if style == "both":
            return F.coalesce(F.concat(_domestic(x), F.lit(" ("), _international(x), F.lit(")")), x)
        return _domestic(x) if style == "domestic" else _international(x)

    made = F.array_compact(F.transform(parts, form))
    return F.when(F.size(made) > 0, F.array_join(made, " / "))


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _handle(c: Column, least: int, none: tuple[str, ...]) -> Column:
    name = _first(c, rf"@([a-zA-Z0-9_]{{{least},32}})(?!\w)")
    return F.when(~F.lower(name).isin(*none), F.concat(F.lit("@"), name))


def _item(seg: Column) -> Column:
    """What one item of a line says: its numbers, whether they are for calls or for a chat, and the chats' addresses."""
    numbers = F.array_compact(F.transform(F.regexp_extract_all(seg, F.lit(rf"({PHONE})(?!\w)"), F.lit(1)), _domestic))

    def of(phones: Column) -> Column:
        chat, app = seg.rlike(TELEGRAM), seg.rlike(WHATSAPP)
        call = seg.rlike(CALL)
        telegram = F.coalesce(F.concat(F.lit("@"), _first(seg, LINKS["telegram"])), _handle(seg, 4, NO_HANDLE), F.get(phones, F.lit(0)))
        whatsapp = F.coalesce(_domestic(_first(seg, LINKS["whatsapp"])), F.get(phones, F.lit(0)))
        none = F.array().cast("array<string>")
        return F.struct(F.when(chat, telegram).alias("telegram"), F.when(app, whatsapp).alias("whatsapp"), F.when(call, phones).otherwise(none).alias("calls"), F.when(call | chat | app, none).otherwise(phones).alias("plain"))

    return one(numbers, of)


def contact_roles(text: Column, phone: Column | None = None, telegram: Column | None = None, whatsapp: Column | None = None) -> Column:
    """struct(phone, telegram, whatsapp) of an advert; the other arguments are what the platform says and fill what the text does not.

    A line's items part where a label or a number follows / or |. An item that names a chat gives that chat its link, handle
    or first number, and the last such item counts; numbers of items that name calls come before unlabelled ones. A number
    that is a chat's is a phone only if there is no other. Without a named chat the first handle anywhere is Telegram's. All
    phones are joined by " / ". A null text says nothing.
    """
    null = F.lit(None).cast("string")
    seeds = [formatted(phone) if phone is not None else null, telegram if telegram is not None else null, whatsapp if whatsapp is not None else null]
    last = lambda v, k: F.try_element_at(F.array_compact(F.transform(v, lambda x: x[k])), F.lit(-1))

    def parted(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, r"\n+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
        items = F.transform(F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, ITEMS))), lambda x: F.trim(x) != ""), _item)
        return one(one(items, lambda v: found(text, v)), settled)

    def found(text: Column, v: Column) -> Column:
        suffix = {k: _domestic(_first(text, rf"(?i)({PHONE})\s*\((?:{words})\)")) for k, words in BEHIND.items()}
        anywhere = F.coalesce(F.concat(F.lit("@"), _first(text, LINKS["telegram"])), _handle(text, 5, NO_HANDLE_ANYWHERE))
        calls = F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(v, lambda x: x["calls"])), F.array(suffix["call"]))))
        plain = F.array_distinct(F.flatten(F.transform(v, lambda x: x["plain"])))
        phones = one(calls, lambda x: F.when(F.size(x) > 0, x).otherwise(plain))
        return F.struct(F.coalesce(last(v, "telegram"), suffix["telegram"], anywhere).alias("t"), F.coalesce(last(v, "whatsapp"), suffix["whatsapp"]).alias("w"), phones.alias("p"))

    def settled(x: Column) -> Column:
        chats = F.array_compact(F.array(x["t"], x["w"]))
        phones = one(F.filter(x["p"], lambda n: ~F.array_contains(chats, n)), lambda v: F.when(F.size(v) > 0, v).otherwise(x["p"]))
        said = one(phones, lambda v: F.when(F.size(v) > 0, F.array_join(v, " / ")))
        return F.struct(F.coalesce(said, seeds[0]).alias("phone"), F.coalesce(x["t"], seeds[1]).alias("telegram"), F.coalesce(x["w"], seeds[2]).alias("whatsapp"))

    return one(F.coalesce(text, F.lit("")), parted)
