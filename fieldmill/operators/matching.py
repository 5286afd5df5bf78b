"""Matching across sources: candidates, evidence, decisions, one-to-one pairs, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.operators.components import connected_components
from fieldmill.operators.dedupe import hamming
from fieldmill.operators.pairing import greedy_pairs
from fieldmill.operators.shaping import first_per_group, row_diff, star_pairs

#: A signal whose two sides give at most so many pairs is matched in full; a larger one by its least members.
FULL_PAIRS = 64


def cross_pairs(signals: DataFrame) -> DataFrame:
    """a, b, signals: pairs of the left and right side that share a signal. signals: id, side (l or r), signal.

    A small signal gives all its pairs, at most FULL_PAIRS; in others all left items meet the least right one and the
    reverse, so a signal with millions of items gives as many pairs as it has items.
    """
    rows = signals.select("id", "side", "signal").distinct()
    least = lambda s: F.min(F.when(F.col("side") == s, F.col("id")))
    sides = rows.groupBy("signal").agg(F.count_if(F.col("side") == "l").alias("nl"), F.count_if(F.col("side") == "r").alias("nr"), least("l").alias("a0"), least("r").alias("b0")).where("nl > 0 AND nr > 0")
    tagged = rows.join(sides, "signal")
    small, large = tagged.where(F.col("nl") * F.col("nr") <= FULL_PAIRS), tagged.where(F.col("nl") * F.col("nr") > FULL_PAIRS)
    full = small.where("side = 'l'").select("signal", F.col("id").alias("a")).join(small.where("side = 'r'").select("signal", F.col("id").alias("b")), "signal")
    left = F.col("side") == "l"
    star = large.select("signal", F.when(left, F.col("id")).otherwise(F.col("a0")).alias("a"), F.when(left, F.col("b0")).otherwise(F.col("id")).alias("b"))
    return full.select("signal", "a", "b").unionByName(star).distinct().groupBy("a", "b").agg(F.count("*").alias("signals"))


#: Pairs that an audit compares at most.
AUDIT_PAIRS = 10_000_000


def audit_pairs(left: DataFrame, right: DataFrame, most: int = 5) -> DataFrame:
    """a, b, distance of all pairs within `most` bits, by a full product: an audit of a retrieval on small tables (id, hash). More than AUDIT_PAIRS pairs are an error."""
    if left.count() * right.count() > AUDIT_PAIRS:
        raise ValueError(f"an audit compares at most {AUDIT_PAIRS} pairs")
    r = right.select(F.col("id").alias("b"), F.col("hash").alias("_hb"))
    return left.select(F.col("id").alias("a"), "hash").join(F.broadcast(r), hamming(F.col("hash"), F.col("_hb")) <= most).select("a", "b", hamming(F.col("hash"), F.col("_hb")).cast("int").alias("distance"))


#: Caps of the evidence families, for the property and for the listing.
CAPS = {"identifiers": (1.0, 1.0), "media": (0.55, 0.35), "contact": (0.35, 0.65), "location": (0.30, 0.25), "structured": (0.25, 0.45), "text": (0.15, 0.20)}
#: Family, sign of evidence, points for the property and for the listing.
POINTS = [
    ("identifiers", "same_code", 0.60, 0.50), ("identifiers", "same_map", 0.60, 0.35), ("identifiers", "same_url", 0.0, 0.40), ("identifiers", "same_text", 0.0, 0.40),
    ("media", "two_hashes", 0.45, 0.20), ("media", "one_hash", 0.25, 0.0), ("media", "shared_photos", 0.25, 0.10),
    ("contact", "same_phone", 0.25, 0.0), ("contact", "same_chat", 0.15, 0.0), ("contact", "same_author", 0.10, 0.0), ("contact", "any_contact", 0.0, 0.45),
    ("location", "same_area", 0.27, 0.05), ("location", "same_city_only", 0.08, 0.0), ("location", "same_latitude", 0.15, 0.0),
    ("structured", "same_beds", 0.08, 0.08), ("structured", "same_baths", 0.05, 0.05), ("structured", "same_type", 0.07, 0.07), ("structured", "price_within_10", 0.05, 0.0),
    ("structured", "price_within_5", 0.0, 0.25), ("structured", "same_terms", 0.0, 0.15), ("structured", "same_offer", 0.0, 0.05),
    ("text", "words_08", 0.10, 0.10), ("text", "words_06", 0.05, 0.05),
]


def evidence_scores(signs: dict[str, Column], offer_conflict: Column | None = None, city_conflict: Column | None = None) -> Column:
    """struct(property, listing): each family's points up to its cap, in all at most 1. An offer conflict holds the listing under 0.7, a city conflict the property at 0.2."""
    out = []
    for side in (0, 1):
        families = []
        for family, caps in CAPS.items():
            own = [F.when(F.coalesce(signs[s], F.lit(False)), (p, q)[side]).otherwise(0.0) for f, s, p, q in POINTS if f == family and s in signs]
            families.append(F.least(F.lit(caps[side]), sum(own, F.lit(0.0))))
        out.append(F.round(F.least(F.lit(1.0), sum(families, F.lit(0.0))), 4))
    prop, listing = out
    if city_conflict is not None:
        prop = F.when(F.coalesce(city_conflict, F.lit(False)), F.least(prop, F.lit(0.2))).otherwise(prop)
    if offer_conflict is not None:
        listing = F.when(F.coalesce(offer_conflict, F.lit(False)), F.least(listing, F.lit(0.69))).otherwise(listing)
    return F.struct(prop.alias("property"), listing.alias("listing"))


def price_within(a: Column, b: Column, share: float) -> Column:
    """Two known prices whose difference is at most a share of the larger one."""
    return (a > 0) & (b > 0) & (F.abs(a - b) <= share * F.greatest(a, b))


def many_hashes(new: Column, old: Column, most: int = 5) -> Column:
    """struct(matches, same): new hashes within `most` bits of an old one; the same from two matches, or one where both have one."""
    n = F.size(F.filter(new, lambda x: F.exists(old, lambda y: hamming(x, y) <= most)))
    n = F.when((F.size(new) > 0) & (F.size(old) > 0), n).otherwise(0)
    return F.struct(n.alias("matches"), ((n >= 2) | ((n == 1) & (F.size(new) == 1) & (F.size(old) == 1))).alias("same"))


def first_duplicate(pairs: DataFrame, item: str, order: Column, same_hash: Column, score: Column, least: int = 75) -> DataFrame:
    """Of each item the first candidate in order that is a duplicate, with its method: pictures before scores."""
    rows = pairs.withColumn("method", F.when(F.coalesce(same_hash, F.lit(False)), "hash").when(score >= least, "score")).withColumn("_o", order).where("method IS NOT NULL")
    return first_per_group(rows, [item], [F.when(F.col("method") == "hash", 0).otherwise(1), F.col("_o")]).drop("_o")


def one_to_one(pairs: DataFrame, least: float = 0.55) -> DataFrame:
    """a, b, score of a matching in which no item occurs twice, the best scores first; exact identities come first by a score over 1."""
    return greedy_pairs(pairs, least)


def candidates(members: DataFrame, group: str, order: str) -> DataFrame:
    """A record for each group of members (identifiers, photos: array<struct<url, hash>>, seen): identifiers and photos united, a photo with its first known hash, first and last sight."""
    ids = members.select(group, F.explode_outer("identifiers").alias("x")).groupBy(group).agg(F.array_sort(F.collect_set("x")).alias("identifiers"))
    photos = members.select(group, order, F.explode("photos").alias("p")).groupBy(group, F.col("p.url").alias("url")).agg(F.min_by("p.hash", F.when(F.col("p.hash").isNotNull(), F.col(order))).alias("hash"))
    photos = photos.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("url", "hash"))).alias("photos"))
    seen = members.groupBy(group).agg(F.count("*").alias("members"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    return seen.join(ids, group, "left").join(photos, group, "left").withColumn("photos", F.coalesce("photos", F.array().cast("array<struct<url:string,hash:bigint>>")))


def rebound_key(key: Column, old_key: Column, current: Column, area: Column, beds_apart: Column, kind: Column, code: Column) -> Column:
    """The key that a group keeps from before, unless a past binding conflicts strongly: a code and any other fact, or area, rooms and kind together.

    area, kind and code are true for a conflict, beds_apart is the difference; null is no conflict.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    beds = no(beds_apart >= 2)
    strong = (no(code) & (no(area) | beds | no(kind))) | (no(area) & beds & no(kind))
    return F.when(old_key.isNull(), key).when(no(current) | ~strong, old_key).otherwise(F.sha2(F.concat(key, F.lit("|repurpose")), 256))


def two_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, property, listing: components over pairs of the same property or listing, and over pairs of the same listing alone. edges: a, b, decision."""
    out = nodes.select("id")
    for name, kinds in (("property", ("SAME_PROPERTY", "SAME_LISTING")), ("listing", ("SAME_LISTING",))):
        of = connected_components(edges.where(F.col("decision").isin(*kinds)), "a", "b").withColumnRenamed("component", f"_{name}")
        out = out.join(of, F.col("id") == F.col("node"), "left").drop("node").withColumn(name, F.coalesce(f"_{name}", "id")).drop(f"_{name}")
    return out


def merged(old: dict[str, Column], new: dict[str, Column]) -> list[Column]:
    """A duplicate folded into a record: the lower known price, the earlier date, other facts only where they are missing."""
    out = []
    for name, a in old.items():
        b = new[name]
        if name == "price":
            c = F.when((b > 0) & ((F.coalesce(a, F.lit(0)) <= 0) | (b < a)), b).otherwise(a)
        elif name == "posted_at":
            c = F.least(a, b)
        else:
            c = F.coalesce(a, b)
        out.append(c.alias(name))
    return out


def filled(new: Column, old: Column) -> Column:
    """A fact extracted anew, where there is one; an empty text counts as none."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def scope_violations(before: DataFrame, after: DataFrame, key: str, affected: DataFrame, columns: list[str], allowed: list[str]) -> DataFrame:
    """Changes that a run limited to the affected keys must not make: any to another key, or to columns that are not allowed."""
    diff = row_diff(before, after, key, columns)
    inside = affected.select(F.col(key).alias("_k")).distinct()
    j = diff.join(inside, F.col(key) == F.col("_k"), "left")
    other = F.size(F.array_except(F.split("changed", ","), F.array(*map(F.lit, allowed))) if allowed else F.split("changed", ",")) > 0
    return j.where(F.col("_k").isNull() | ((F.col("change") == "UPDATE") & other)).drop("_k")


def golden_pairs(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """positives, recalled, false_merges of decisions (a, b, decision) against labels (a, b, label SAME or DIFFERENT)."""
    j = labels.join(decisions, ["a", "b"], "left")
    same, merged_ = F.col("label") == "SAME", F.coalesce(F.col("decision").isin("SAME_LISTING", "SAME_PROPERTY"), F.lit(False))
    return j.agg(F.count_if(same).alias("positives"), F.count_if(same & merged_).alias("recalled"), F.count_if(~same & merged_).alias("false_merges"))


def affected_closure(signals: DataFrame, changed: DataFrame) -> DataFrame:
    """id of all items that a chain of shared signals links to a changed one, the changed ones included: what an incremental run must cluster again."""
    of = connected_components(star_pairs(signals), "a", "b")
    hit = of.join(changed.select(F.col("id").alias("_c")), F.col("node") == F.col("_c"), "left_semi").select("component").distinct()
    return of.join(hit, "component", "left_semi").select(F.col("node").alias("id")).unionByName(changed.select("id")).distinct()


def kept_cluster_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, cluster: new clusters (id, cluster) under the least old cluster's identifier that their members had; of two that claim one, that with the least member keeps it."""
    j = new.join(old.select("id", F.col("cluster").alias("_old")), "id", "left")
    claim = j.groupBy("cluster").agg(F.min("_old").alias("_claim"), F.min("id").alias("_least"))
    w = Window.partitionBy("_claim").orderBy("_least")
    claim = claim.withColumn("_rn", F.row_number().over(w)).select(F.col("cluster").alias("_new"), F.when((F.col("_rn") == 1) & F.col("_claim").isNotNull(), F.col("_claim")).alias("_keep"))
    return new.join(claim, F.col("cluster") == F.col("_new")).select("id", F.coalesce("_keep", "cluster").alias("cluster"))


def demand_rule(s: Column, same_url: Column, same_identity: Column, hours_apart: Column, n: Column) -> Column:
    """struct(method, confidence) of two requests for housing; null if they differ or one is undated."""
    close = same_identity & (hours_apart <= 72) & (s >= 0.88) & (n >= 5)
    conf = F.least(F.lit(0.97), 0.72 + 0.28 * s)
    return F.when(F.coalesce(same_url & (s >= 0.55), F.lit(False)), F.struct(F.lit("source_url").alias("method"), conf.alias("confidence"))).when(F.coalesce(close, F.lit(False)), F.struct(F.lit("identity_window").alias("method"), conf.alias("confidence")))


def blocked_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that blocks a repair; a rule that cannot be decided blocks too."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules])


def multiset_dice(a: Column, b: Column) -> Column:
    """Twice the common words, repeats counted, over all words of both arrays.

    In sorted order a word's repeats are a run, whose members are numbered; numbered words are distinct strings, so
    array_intersect() counts repeats, by a hash table.
    """

    def numbered(words: Column) -> Column:
        ordered = F.array_sort(words)
        at = F.transform(ordered, lambda w, i: F.struct(w.alias("w"), i.alias("i"), (F.coalesce(w != F.get(ordered, i - 1), F.lit(True))).alias("first")))
        runs = F.filter(at, lambda x: x["first"])
        sized = F.transform(runs, lambda x, j: F.struct(x["w"].alias("w"), (F.coalesce(F.get(runs, j + 1)["i"], F.size(words)) - x["i"]).alias("n")))
        return F.flatten(F.transform(sized, lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda n: F.concat_ws("\u0001", x["w"], n.cast("string")))))

    n = F.size(a) + F.size(b)
    return F.when(n > 0, 2.0 * F.size(F.array_intersect(numbered(a), numbered(b))) / n).otherwise(0.0)


def corroborated(posts: DataFrame, group: str, ident: str, body: str, author: str, least: int = 2, most: int = 12) -> DataFrame:
    """group, ok: whether all posts of a group, 2 to 12 of them, are long enough and equal to the first, or by its author with the same numbers and at least 0.97 of the words.

    A group over the limit is not gathered: it is held by its count.
    """
    n = posts.groupBy(group).agg(F.count("*").alias("_n"), F.min(ident).alias("_first"))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(body)), r"https?://[^ \n]+", " "), r"[^\p{L}\p{N}]+", " ")), " ")
    numbers = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.col(body), F.lit(r"([0-9]+(?:[.,][0-9]+)*)"), F.lit(1)), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) <= 6)))
    rows = posts.join(n.where(F.col("_n").between(least, most)), group).select(group, ident, "_first", words.alias("_w"), numbers.alias("_num"), F.col(author).alias("_by"), F.length(F.trim(F.col(body))).alias("_len"))
    first = rows.where(F.col(ident) == F.col("_first")).select(F.col(group).alias("_g"), F.col("_w").alias("_fw"), F.col("_num").alias("_fnum"), F.col("_by").alias("_fby"))
    j = rows.join(first, F.col(group) == F.col("_g"))
    same_author, exact = F.coalesce((F.col("_by") == F.col("_fby")) & (F.col("_by") != ""), F.lit(False)), F.col("_w") == F.col("_fw")
    fine = (F.col("_len") >= 120) & (F.size("_w") >= 35) & ((F.col("_len") >= 160) | (exact & same_author)) & (exact | (same_author & (F.col("_num") == F.col("_fnum")) & (multiset_dice(F.col("_fw"), F.col("_w")) >= 0.97)))
    good = j.groupBy(group).agg(F.bool_and(fine).alias("_ok"))
    return n.join(good, group, "left").select(group, F.coalesce("_ok", F.lit(False)).alias("ok"))
