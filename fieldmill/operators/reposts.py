"""Reposts among offers: candidates that are linear in a signal's posts, the ladder of rules, and the veto of shared agencies."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.functions import text
from fieldmill.operators.components import _cut, shared_folder

#: Posts of an author that share one pivot. Fixed value.
SLICE = 80
#: Least similarity of each rule that looks at texts. Fixed values.
URL_TEXT, CODE_TEXT, IDENTIFIERS_TEXT, CONTACT_TEXT, TEXT_ONLY = 0.55, 0.72, 0.74, 0.86, 0.95
CONTACTS = ("PHONE", "TELEGRAM", "WHATSAPP", "EMAIL")
#: Too frequent words that tasks leave out before the shuffle, the most frequent ones; others are left out behind it.
FREQUENT = 100_000
#: Counters of a sketch.
COUNTERS = 256


def fixed_signals(items: DataFrame, *keep: str, words: Column | None = None) -> DataFrame:
    """id, signal, keep: content hash, text, address, identifiers and author; items: id, content_hash, url, author, norm, tokens, identifiers ("TYPE:value"), keep.

    An author's posts are signals in slices of SLICE in order of their identifiers, so a generic author gives as many
    candidates as posts, and posts that lie near to each other meet. words: the number of tokens, if it is known.
    """
    c = F.col
    n = F.size("tokens") if words is None else words
    one = lambda name, value, when: F.when(F.coalesce(when, F.lit(False)), F.concat(F.lit(f"{name}:"), value))
    fixed = F.array_compact(F.array(one("hash", c("content_hash"), (c("content_hash") != "") & (c("norm") != "")), one("print", F.sha2("norm", 256), n >= 3), one("url", c("url"), c("url") != "")))
    ids = F.transform(F.coalesce("identifiers", F.array().cast("array<string>")), lambda x: F.concat(F.lit("identifier:"), x))
    out = items.select("id", F.explode(F.concat(fixed, ids)).alias("signal"), *keep)
    place = F.row_number().over(Window.partitionBy("author").orderBy("id")) - 1
    authors = items.where((c("author") != "") & c("author").isNotNull()).select("id", "author", *keep).withColumn("_slice", F.floor(place / SLICE))
    return out.unionByName(authors.select("id", F.concat_ws("#", F.concat(F.lit("author:"), "author"), "_slice").alias("signal"), *keep))


def word_signals(items: DataFrame, *keep: str) -> DataFrame:
    """id, signal, keep: each word of an item (id, tokens, keep) but short numbers."""
    words = items.select("id", F.explode("tokens").alias("_t"), *keep).where(~F.col("_t").rlike("^[0-9]{1,2}$"))
    return words.select("id", F.concat(F.lit("token:"), "_t").alias("signal"), *keep)


def signals(items: DataFrame) -> DataFrame:
    """id, signal of what two reposts may share: fixed_signals() and word_signals()."""
    return fixed_signals(items).unionByName(word_signals(items))


def decision(s: Column, words: Column, chars: Column, same_hash: Column, same_url: Column, same_print: Column, same_author: Column, shared: Column) -> Column:
    """struct(method, confidence) of a pair, null if no rule holds. words and chars are the first post's distinct words and the length of its normalised text; shared: the identifiers of both.

    A property's code or a place on a map makes several identifiers evidence; contacts alone describe an agent. What two
    posts of one agency share is only evidence with a second identifier and similar texts, unless they share a
    property's code, the text or the address.
    """
    count = lambda *kinds: F.size(F.filter(shared, lambda x: F.substring_index(x, ":", 1).isin(*kinds)))
    codes, contacts, places, agencies = count("PROPERTY_CODE"), count(*CONTACTS), count("MAPS_URL", "MAPS_PLACE_ID"), count("AGENCY_CODE")
    several = (F.size(shared) >= 2) & (((codes > 0) & ((contacts > 0) | (places > 0))) | ((places > 0) & ((contacts > 0) | (agencies > 0))))
    rule = lambda name, confidence: F.struct(F.lit(name).alias("method"), confidence.cast("double").alias("confidence"))
    bounded = lambda most, base, share: F.least(F.lit(most), base + share * s)
    by_text = (s >= CONTACT_TEXT) & (words >= 5)
    ladder = (
        F.when(same_hash & (words >= 2), rule("content_hash", F.lit(1.0)))
        .when(same_url & (s >= URL_TEXT) & (words >= 3), rule("source_url", F.greatest(F.lit(0.97), s)))
        .when(same_print & (words >= 3) & (chars >= 25), rule("text_fingerprint", F.greatest(F.lit(0.97), s)))
        .when((codes > 0) & (s >= CODE_TEXT), rule("property_code", bounded(0.99, 0.72, 0.28)))
        .when(several & (s >= IDENTIFIERS_TEXT), rule("multiple_identifiers", bounded(0.98, 0.68, 0.30)))
        .when(same_author & by_text, rule("author_text", bounded(0.97, 0.70, 0.30)))
        .when((contacts > 0) & by_text, rule("contact_text", bounded(0.97, 0.70, 0.30)))
        .when((s >= TEXT_ONLY) & (words >= 6), rule("text_only", s))
    )
    veto = (agencies > 0) & (codes == 0) & ~same_hash & ~(same_print & (words >= 3)) & ~same_url & ((F.size(shared) < 2) | (s < IDENTIFIERS_TEXT))
    return F.when(~veto, ladder)


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: texts are normalised once."""
    path = os.path.join(shared_folder(df.sparkSession), f"posts-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _brief() -> Column:
    """What bounds a pair's similarity before its texts are read: the number of words, hashes of what is equal (0: none), and a bit for each identifier, contacts and others apart."""
    c = F.col
    hashed = lambda name, when: F.when(F.coalesce(when, F.lit(False)), F.xxhash64(name)).otherwise(F.lit(0).cast("long"))
    contact = lambda x: F.substring_index(x, ":", 1).isin(*CONTACTS)
    bits = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))
    same = hashed("content_hash", (c("norm") != "") & (c("content_hash") != "")), hashed("url", c("url") != ""), hashed("author", c("author") != "")
    named = zip(("n", "hash", "url", "author", "contacts", "others"), (F.size("tokens"), *same, bits(F.filter("identifiers", contact)), bits(F.filter("identifiers", lambda x: ~contact(x)))))
    return F.struct(*[x.alias(name) for name, x in named])


def _least_words(a: Column, b: Column) -> Column:
    """The least Jaccard index of the words with which any rule may hold for a pair of _brief(): a rule's least similarity less 0.3 for trigrams all in common."""
    equal = lambda name: (a[name] == b[name]) & (a[name] != 0)
    meet = lambda name: a[name].bitwiseAND(b[name]) != 0
    of = lambda s: F.lit((s - 0.3) / 0.7 - 1e-9)
    return F.when(equal("hash"), F.lit(0.0)).when(equal("url"), of(URL_TEXT)).when(meet("others"), of(min(CODE_TEXT, IDENTIFIERS_TEXT))).when(equal("author") | meet("contacts"), of(CONTACT_TEXT)).otherwise(of(TEXT_ONLY))


def _sketches(rows: DataFrame) -> DataFrame:
    """id, sketch: how many of an item's words fall to each of COUNTERS hash values, at most 127. Two sketches differ by no more, in sum, than the words of the two items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["_w"]
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(lists)), sizes) * COUNTERS + lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.minimum(np.bincount(at, minlength=len(lists) * COUNTERS), 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * COUNTERS, pa.array(counts))], names=["id", "sketch"])

    w = F.transform("tokens", lambda t: F.xxhash64(t).bitwiseAND(COUNTERS - 1).cast("int"))
    return rows.select("id", F.coalesce(w, F.array().cast("array<int>")).alias("_w")).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sketch array<tinyint>")


def candidate_pairs(rows: DataFrame, most_posts: int = 45, frequent: int = FREQUENT) -> DataFrame:
    """a, b, apart: the least item of each signal with its others, where some rule may hold by what `brief`, _brief() of each row, has; apart: in how many words they may differ then.

    Words of more than min(most_posts, 12 % of the items or 8) items are no signals. Most occurrences are of few such words,
    so the most frequent of these, a bounded number, are left out where texts are read; only what is left is shuffled.
    """
    c = F.col
    n = rows.count()
    cap = min(max(8, -(-n * 12 // 100)), most_posts)
    counts = word_signals(rows).groupBy("signal").agg(F.count("*").alias("_n")).where(c("_n") > cap)
    heads = counts.orderBy(F.desc("_n"), "signal").limit(frequent).select("signal")
    words = word_signals(rows, "brief").join(F.broadcast(heads), "signal", "left_anti")
    first = F.min(F.when(c("id").isNotNull(), F.struct("id", "brief")))
    of = Window.partitionBy("signal")
    words = words.withColumn("_n", F.count("*").over(of)).withColumn("_first", first.over(of)).where((c("_n") > 1) & (c("_n") <= cap))
    # Other signals may have any number of items, so these are joined, not gathered.
    rest = _cut(fixed_signals(rows, "brief", words=c("brief.n")))
    pivots = rest.groupBy("signal").agg(first.alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    both = words.select("id", "brief", "_first").unionByName(rest.join(pivots, "signal").select("id", "brief", "_first"))
    j = both.where(c("id") != c("_first.id")).select(c("_first.id").alias("a"), c("id").alias("b"), c("_first.brief").alias("_a"), c("brief").alias("_b"))
    na, nb, least = c("_a.n"), c("_b.n"), _least_words(c("_a"), c("_b"))
    j = j.withColumn("_t", least)
    apart = F.floor((na + nb) * (1 - c("_t")) / (1 + c("_t")) + 1e-6).cast("int")
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return j.where(F.least(na, nb) >= c("_t") * F.greatest(na, nb)).select("a", "b", apart.alias("apart")).distinct()
    return j.select("a", "b", F.lit((1 << 31) - 1).alias("apart")).distinct()  # an identifier's rows may differ


def repost_pairs(items: DataFrame, most_posts: int = 45) -> DataFrame:
    """a, b, similarity, method, confidence of the candidates that a rule accepts.

    The similarity is 0.7 of the words' Jaccard index and 0.3 of the trigrams' Dice index, so what a rule takes at least
    needs an index of words that is known from what else the pair shares. It bounds the numbers of words first, then the
    difference of sketches of the words; texts are only read, and trigrams only made, of pairs that are left.
    """
    c = F.col
    rows = _written(items.withColumn("identifiers", F.coalesce("identifiers", F.array().cast("array<string>"))).withColumn("brief", _brief()))
    side = lambda frame, x: frame.select(*[c(name).alias(x if name == "id" else f"{name}_{x}") for name in frame.columns])
    pairs = _cut(candidate_pairs(rows, most_posts))
    sketches = _written(_sketches(rows))
    j = pairs.join(side(sketches, "a").hint("merge"), "a").join(side(sketches, "b").hint("merge"), "b")
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda acc, x: acc + x)
    j = _cut(j.where(differ <= c("apart")).select("a", "b").distinct())
    ids = j.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = rows.select("id", "content_hash", "url", "author", "norm", "tokens", "identifiers").join(ids.hint("merge"), "id", "left_semi")
    j = j.join(side(whole, "a").hint("merge"), "a").join(side(whole, "b").hint("merge"), "b")
    # The arrays are bound to a lambda's variable, so each is made once, and only their sizes are kept.
    grams = lambda x: F.transform(F.array(F.struct(text.trigrams(x["norm_a"]).alias("a"), text.trigrams(x["norm_b"]).alias("b"))), lambda g: F.struct(F.size(F.array_intersect(g["a"], g["b"])).alias("both"), (F.size(g["a"]) + F.size(g["b"])).alias("all")))[0]
    sizes = F.transform(F.array(F.struct("norm_a", "norm_b", F.size(F.array_intersect("tokens_a", "tokens_b")).alias("both"))), lambda x: F.struct(x["both"].alias("words"), grams(x).alias("grams")))[0]
    equal = lambda name: F.coalesce((c(f"{name}_a") == c(f"{name}_b")) & (c(f"{name}_a") != ""), F.lit(False))
    known = {"words": F.size("tokens_a"), "chars": F.length("norm_a"), "same_hash": equal("content_hash") & (c("norm_a") != ""), "same_url": equal("url"), "same_print": equal("norm"), "same_author": equal("author"), "shared": F.array_intersect("identifiers_a", "identifiers_b")}
    j = _cut(j.select("a", "b", F.size("tokens_b").alias("words_b"), sizes.alias("both"), *[x.alias(name) for name, x in known.items()]))
    words = c("both.words") / F.greatest(c("words") + c("words_b") - c("both.words"), F.lit(1))
    s = 0.7 * words + 0.3 * (2.0 * c("both.grams.both") / F.greatest(c("both.grams.all"), F.lit(1)))
    j = j.withColumn("similarity", s)
    return j.withColumn("r", decision(c("similarity"), **{name: c(name) for name in known})).where("r IS NOT NULL").select("a", "b", "similarity", "r.method", "r.confidence")
