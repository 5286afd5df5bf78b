"""Personal data: spans of fixed kinds, and terms that disclose them by co-occurrence in the corpus. DataFrame functions only."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common

KINDS = ("email", "ip", "card", "phone")
# The kinds' patterns, written so that a failed start is not tried again within the same run of characters; what they match is the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
TERM = r"[\p{L}\p{N}]{4,}"
#: What a text must hold for a kind to be looked for; what stands for a code point of a span while terms are looked for; code points of a piece.
CUES = ("@", r"[0-9]\.[0-9]", "[0-9]{2}|[0-9][ -][0-9]", r"\+[0-9]")
MARK, PIECE = "\u0001", 1024
#: Texts in which an entity, and an entity with a term, must occur.
SUPPORT = 3
#: Share of an entity's information that a term must disclose to be removed, or to be generalised.
REMOVE, GENERALISE = 0.95, 0.85
#: Rows of a table of entities, terms or texts' keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    marks = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, F.try_to_number(x, F.lit("9")).cast("int")).otherwise((F.try_to_number(x, F.lit("9")).cast("int") * 2 / 10).cast("int") + F.try_to_number(x, F.lit("9")).cast("int") * 2 % 10))
    return F.coalesce(F.aggregate(marks, F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(PART))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, largest: bool = False) -> Column:
    """Running sums (or maxima) of an array of int. Arrays are walked in blocks of about the root of their size, so appending stays cheap in long ones."""
    step = F.greatest if largest else (lambda a, x: a + x)
    none = F.array().cast("array<int>")

    def blocks(v: Column) -> Column:
        block = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v))).cast("int"))
        count = F.when(F.size(v) > 0, ((F.size(v) - 1) / block).cast("int")).otherwise(0)
        return F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(v, i * block + 1, block))

    def joined(runs: Column) -> Column:
        last = F.transform(runs, lambda run: F.coalesce(F.try_element_at(run, F.lit(-1)), F.lit(0)))
        before = F.aggregate(last, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x)))
        return F.flatten(F.zip_with(runs, F.slice(before, F.lit(1), F.size(runs)), lambda run, had: F.transform(run, lambda x: step(had, x))))

    run = lambda part: F.aggregate(part, none, lambda acc, x: F.array_append(acc, step(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x)))
    return _let(F.transform(_let(values, blocks), run), joined)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of a pattern's matches, in code points: what lies between matches gives their places."""

    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = _running(F.zip_with(found, between, lambda m, gap: F.length(gap) + F.length(m)))
        return F.zip_with(found, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("m")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


SPANS = "array<struct<start:int,order:int,kind:string,end:int,entity:string>>"


def base_spans(text: Column) -> Column:
    """The spans of the four kinds, by start and then kind."""
    def of(order: int, kind: str, pattern: str, cue: str) -> Column:
        def made(s: Column) -> Column:
            entity = F.lower(s["m"]) if kind in ("email", "ip") else _digits(s["m"])
            return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.concat(F.lit(kind + ":"), entity).alias("entity"))

        some = text.rlike(cue)
        spans = F.transform(F.filter(located(text, pattern), lambda s: _valid(kind, s["m"])), made)
        return F.when(some, spans).otherwise(F.array().cast(SPANS))

    parts = [of(*x) for x in zip(range(len(KINDS)), KINDS, (EMAIL, IP, CARD, PHONE), CUES)]
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blanked(text: Column) -> Column:
    """The text with every code point of what the kinds' patterns take from it, one kind after another, made a mark that is in no term, so that places stay."""

    def without(text: Column, kind: str, pattern: str, cue: str) -> Column:
        found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        parts = F.zip_with(between, found, lambda gap, m: F.concat(gap, F.when(m.isNull(), "").when(_valid(kind, m), F.repeat(F.lit(MARK), F.length(m))).otherwise(m)))
        return F.when(text.rlike(cue), F.array_join(parts, "")).otherwise(text)

    for x in zip(KINDS, (EMAIL, IP, CARD, PHONE), CUES):
        text = _let(text, partial(lambda args, t: without(t, *args), x))
    return text


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points, for cut()."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text in pieces(), without a walk over the text."""
    first, last = (start / PIECE).cast("int"), ((end - 1) / PIECE).cast("int")
    head, tail = F.get(parts, first), F.get(parts, last)
    long = F.concat(F.substring(head, start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(tail, F.lit(1), (end - 1) % PIECE + 1))
    return F.when(start >= end, "").when(first == last, F.substring(head, start % PIECE + 1, end - start)).otherwise(long)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (digest of the text), base spans, and the text's distinct terms outside of them; in the shared folder, without the texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("_t"))
    rows = rows.select("doc_id", F.md5("_t").alias("key"), "_t", base_spans(F.col("_t")).alias("base"))
    words = F.regexp_extract_all(blanked(F.col("_t")), F.lit(TERM), F.lit(0))
    return common.written(rows.select("doc_id", "key", "base", F.array_distinct(F.transform(words, F.lower)).alias("terms")), "pii")


def disclosing(texts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """entity, term, action: the terms whose co-occurrence with an entity in the corpus discloses it. texts: found(), a row for each key.

    With N texts, IC(e) = log2(N / n(e)) and PMI(e, t) = log2(n(e, t) N / (n(e) n(t))), the share PMI / IC is 1 if t is
    never found without e. All counts are of whole texts, wherever in them e and t stand; texts are counted once, however
    many copies there are. An entity of every text has no information to disclose.
    """
    total = texts.count()
    mentions = texts.where(F.size("base") > 0).select("terms", F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity"))
    entities = common.cut(mentions.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= support) & (F.col("n_e") < total)))
    pairs = mentions.join(_small(entities), "entity").select("entity", "n_e", F.explode("terms").alias("term"))
    pairs = common.cut(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.first("n_e").alias("n_e")).where(F.col("n_et") >= support))
    n_t = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= support)
    share = 1 + F.log2(F.col("n_et") / F.col("n_t")) / F.log2(F.lit(float(total)) / F.col("n_e"))
    scored = pairs.join(n_t, "term").withColumn("share", F.when(F.col("n_et") >= F.col("n_t"), 1.0).otherwise(share))
    return scored.where(F.col("share") >= GENERALISE).select("entity", "term", F.when(F.col("share") >= REMOVE, "removed").otherwise("generalised").alias("action"))


def _placed(text: Column, marks: Column) -> Column:
    """Spans of the terms in a text that marks (array of term and order) names."""
    orders = F.map_from_entries(marks)
    kind = lambda order: F.when(order == 4, "removed").otherwise("generalised")
    hits = F.filter(F.transform(located(text, TERM), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), orders[F.lower(s["m"])].alias("order"))), lambda s: s["order"].isNotNull())
    return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), kind(s["order"]).alias("kind"), s["end"].alias("end"), F.lit("").alias("entity")))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """doc_id, key, base, all_spans for each row of docs: base spans and those of terms that disclose an entity, wherever a text has them.

    A null text counts as empty and has no spans; a null doc_id stays null; repeated rows are kept, each with its spans.
    An empty table gives an empty result; other columns are not read. Texts are searched whole, in time linear in their
    length but for the numbers of spans.
    """
    rows = found(docs, id_col, text_col)
    base, each = rows.drop("terms"), rows.select("key", "base", "terms")
    copied = _small(common.cut(rows.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")))
    texts = each.join(copied, "key", "left_anti").unionByName(each.join(copied, "key", "left_semi").dropDuplicates(["key"]))
    terms = common.cut(disclosing(texts, support).groupBy("term").agg(F.min(F.when(F.col("action") == "removed", 4).otherwise(5)).alias("order")))
    hits = texts.select("key", F.explode("terms").alias("term")).join(_small(terms), "term").groupBy("key").agg(F.collect_list(F.struct("term", "order")).alias("marks"))
    hits = common.cut(hits)
    with_text = docs.select(common.text_of(text_col).alias("_t")).withColumn("key", F.md5("_t")).join(_small(hits), "key")
    extra = with_text.select("key", _placed(blanked(F.col("_t")), F.col("marks")).alias("extra")).dropDuplicates(["key"])
    out = base.join(extra, "key", "left")
    return out.select("doc_id", "key", "base", F.array_sort(F.concat("base", F.coalesce(F.col("extra").cast(SPANS), F.array().cast(SPANS)))).alias("all_spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_spans(common.table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with its spans (by start) replaced: a removed term by nothing, a generalised one by its class ([NUMBER],
    [CODE] of digits and letters, [NAME] with a leading capital, or [WORD]), others by their kind in brackets. Of spans
    that overlap, the first names the place, and all of what they cover goes."""
    general = lambda w: F.when(w.rlike(r"^\p{N}+$"), "[NUMBER]").when(w.rlike(r"\p{N}"), "[CODE]").when(w.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")

    def whole(parts: Column, ends: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            had = F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
            named = F.when(s["kind"] == "removed", "").when(s["kind"] == "generalised", general(cut(parts, s["start"], s["end"]))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.when(s["start"] >= had, F.concat(cut(parts, had, s["start"]), named)).otherwise("")

        return F.concat(F.array_join(F.transform(spans, piece), ""), cut(parts, F.element_at(ends, -1), F.length(text)))

    ends = _running(F.transform(spans, lambda s: s["end"]), largest=True)
    return F.when(F.size(spans) > 0, _let(pieces(text), lambda parts: _let(ends, lambda e: whole(parts, e)))).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """docs with spans replaced in text_col, all other columns and rows unchanged; a null text stays null. Columns of any name may be there."""
    spans = find_spans(docs, id_col, text_col, support).where(F.size("all_spans") > 0).select(F.col("key").alias("_pii_key"), F.col("all_spans").alias("_pii_spans")).dropDuplicates(["_pii_key"])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.md5(common.text_of(text_col)).alias("_key"))
    out = rows.join(spans, rows["_key"] == spans["_pii_key"], "left")
    old = F.col("_row").getField(text_col)
    text = F.when(F.col("_pii_spans").isNotNull(), replaced(F.coalesce(old.cast("string"), F.lit("")), F.col("_pii_spans"))).otherwise(old)
    return out.select(*[(text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
