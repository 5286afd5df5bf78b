"""Reposts and cross-source duplicates: signals, pairs, decisions, golden records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fieldmill.functions import text
from fieldmill.operators.components import connected_components
from fieldmill.operators.shaping import first_per_group, star_pairs


def signal_index(items: DataFrame) -> DataFrame:
    """(id, signal) of items with content_hash, url, author, norm, identifiers and tokens: what two reposts may share.

    The digest of the normalised text and identifiers (array of type:value) are signals of their own, so posts that are
    equal but for wording that all share are found although their tokens are too frequent to be signals.
    """
    fixed = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{c}:"), F.col(c))) for c in ("content_hash", "url", "author") if c in items.columns]))
    if "norm" in items.columns:
        fixed = F.concat(fixed, F.array_compact(F.array(F.when(F.length("norm") >= 25, F.concat(F.lit("fingerprint:"), F.sha2("norm", 256))))))
    if "identifiers" in items.columns:
        fixed = F.concat(fixed, F.transform(F.coalesce("identifiers", F.array().cast("array<string>")), lambda x: F.concat(F.lit("identifier:"), x)))
    all_ = F.concat(fixed, F.transform("tokens", lambda t: F.concat(F.lit("token:"), t))) if "tokens" in items.columns else fixed
    return items.select("id", F.explode(all_).alias("signal"))


def capped(signals: DataFrame, n: int) -> DataFrame:
    """Token signals of at most min(max(8, 12 % of n), 45) items; other signals are kept whole."""
    cap = min(max(8, -(-n * 12 // 100)), 45)
    rare = signals.groupBy("signal").agg(F.count("*").alias("_n")).where(~F.startswith("signal", F.lit("token:")) | (F.col("_n") <= cap))
    return signals.join(rare.select("signal"), "signal", "left_semi")


def repost_rule(s: Column, same_hash: Column, same_url: Column, same_print: Column, same_author: Column, n: Column, property_code: Column | None = None, shared_ids: Column | None = None) -> Column:
    """struct(method, confidence) of a pair: the first rule of the ladder that holds; null if none does."""
    rule = lambda name, conf: F.struct(F.lit(name).alias("method"), conf.cast("double").alias("confidence"))
    return (
        F.when(same_hash & (n >= 2), rule("content_hash", F.lit(1.0)))
        .when(same_url & (s >= 0.55) & (n >= 3), rule("source_url", F.greatest(F.lit(0.97), s)))
        .when(same_print, rule("text_fingerprint", F.greatest(F.lit(0.97), s)))
        .when((F.lit(False) if property_code is None else property_code) & (s >= 0.72), rule("property_code", F.greatest(F.lit(0.96), s)))
        .when((F.lit(0) if shared_ids is None else shared_ids) >= F.when(s >= 0.74, 2), rule("multiple_identifiers", F.greatest(F.lit(0.94), s)))
        .when(same_author & (s >= 0.86) & (n >= 5), rule("author_text", F.least(F.lit(0.97), 0.70 + 0.30 * s)))
        .when((s >= 0.95) & (n >= 6), rule("text_only", s))
    )


def repost_edges(items: DataFrame, n: int) -> DataFrame:
    """a, b, similarity, method, confidence of the pairs that a rule accepts. Candidates are stars over capped signals."""
    pairs = star_pairs(capped(signal_index(items), n))
    cols = ["content_hash", "url", "author", "norm", "tokens", "grams", "identifiers"]
    if "identifiers" not in items.columns:
        items = items.withColumn("identifiers", F.array().cast("array<string>"))
    items = items.withColumn("grams", text.trigrams(F.col("norm")))
    left = items.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    right = items.select(F.col("id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = pairs.join(left, "a").join(right, "b")
    s = text.similarity(F.col("a_tokens"), F.col("b_tokens"), F.col("a_grams"), F.col("b_grams"))
    j = j.withColumn("similarity", s)
    same = lambda c: F.coalesce((F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col(f"a_{c}") != ""), F.lit(False))
    shared = F.coalesce(F.array_intersect("a_identifiers", "b_identifiers"), F.array().cast("array<string>"))
    rule = repost_rule(F.col("similarity"), same("content_hash"), same("url"), same("norm") & (F.length("a_norm") >= 25), same("author"), F.size("a_tokens"), F.exists(shared, lambda x: F.startswith(x, F.lit("PROPERTY_CODE:"))), F.size(shared))
    return j.withColumn("r", rule).where("r IS NOT NULL").select("a", "b", "similarity", "r.method", "r.confidence")


def clusters(items: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster (least id), single items included."""
    of = connected_components(edges, "a", "b")
    return items.select("id").join(of, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes; null if one is null."""
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column) -> Column:
    """A 64-bit hash of a vector: bit i is set if component i is positive."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(vector, i) > 0, F.shiftleft(F.lit(1).cast("long"), 1) * 0 + 1).otherwise(0).cast("string"))
    half = lambda at: F.conv(F.array_join(F.slice(bits, at, 32), ""), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def band_pairs(hashes: DataFrame, most: int, bands: int | None = None) -> DataFrame:
    """a, b, distance of hashes that differ in at most `most` < 2 * bands bits: in one of the bands at most one bit differs.

    One side looks up its band's value and all values a bit away, so bands are wide enough to tell hashes apart: the fewest
    that `most` allows, so 21 or 22 bits of 64 for 5. The look-ups are many times the rows, so the join is by sorting: a
    guess from the file's size would have them broadcast.
    """
    bands = max(2, most // 2 + 1) if bands is None else bands
    if most >= 2 * bands:
        raise ValueError("most must be less than twice the bands")
    width = 64 // bands
    last = 64 - width * (bands - 1)
    rows = hashes.select("id", "hash", F.posexplode(F.array(*[F.shiftrightunsigned("hash", width * i).bitwiseAND((1 << (last if i == bands - 1 else width)) - 1) for i in range(bands)])).alias("band", "value"))
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(last)])
    right = rows.select(F.col("id").alias("b"), F.col("hash").alias("hb"), F.col("band").alias("_band"), F.explode(F.transform(ball, lambda x: x.bitwiseXOR(F.col("value")))).alias("_value"))
    on = [rows["band"] == right["_band"], rows["value"] == right["_value"], rows["id"] < right["b"], hamming(rows["hash"], right["hb"]) <= most]
    return rows.join(right.hint("merge"), on).select(F.col("id").alias("a"), "b", hamming(F.col("hash"), F.col("hb")).cast("int").alias("distance")).distinct()


def weighted_score(price_a: Column, price_b: Column, same_rooms: Column, same_category: Column, same_contact: Column) -> Column:
    """30 for prices within 5 % of the first, 25 for rooms, 20 for the category, 15 for a contact; 75 and more is a duplicate."""
    near = (price_a > 0) & (price_b > 0) & (F.abs(price_a - price_b) <= 0.05 * price_a)
    points = [(near, 30), (same_rooms, 25), (same_category, 20), (same_contact, 15)]
    return sum((F.when(F.coalesce(c, F.lit(False)), p).otherwise(0) for c, p in points), F.lit(0))


def decide(prop: Column, listing: Column) -> Column:
    return F.when((prop >= 0.9) & (listing >= 0.9), "SAME_LISTING").when((prop >= 0.9) & (listing < 0.7), "SAME_PROPERTY").when(prop >= 0.7, "POSSIBLE").otherwise("DIFFERENT")


def price_bucket(price: Column) -> Column:
    return F.when(price > 0, F.round(F.log(price) / F.log(F.lit(1.2))).cast("long"))


def golden(rows: DataFrame, group: str, completeness: Column, published: str, ident: str, facts: list[str]) -> DataFrame:
    """A row for each group: the most complete record's id, and the facts of the earliest published one."""
    best = first_per_group(rows.withColumn("_c", completeness), [group], [F.desc("_c"), F.asc(ident)]).select(group, F.col(ident).alias("best_id"))
    first = first_per_group(rows, [group], [F.col(published).asc_nulls_last(), F.asc(ident)]).select(group, F.col(ident).alias("first_id"), *facts)
    return best.join(first, group)


def cluster_keys(assigned: DataFrame, kind: str) -> DataFrame:
    """cluster, key: the digest of the kind and all identifiers of each cluster in order, one formula at any size.

    A cluster's identifiers pass one task sorted, and the digest takes them in batch by batch, so none is ever held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, digest, schema = None, None, None
        for b in batches:
            schema, done = b.schema, ([], [])
            for c, rows in groupby(zip(b["cluster"].to_pylist(), b["_id"].to_pylist()), key=itemgetter(0)):
                if digest is None or c != cluster:
                    if digest is not None:
                        done[0].append(cluster)
                        done[1].append(digest.hexdigest())
                    cluster, digest, lead = c, hashlib.sha256(), kind + "|"
                else:
                    lead = ","
                digest.update((lead + ",".join(x for _, x in rows)).encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], schema.field("cluster").type), pa.array(done[1], pa.string())], names=["cluster", "key"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([cluster], schema.field("cluster").type), pa.array([digest.hexdigest()], pa.string())], names=["cluster", "key"])

    rows = assigned.where("id IS NOT NULL AND cluster IS NOT NULL").repartition("cluster").sortWithinPartitions("cluster", "id")
    out = StructType([StructField("cluster", assigned.schema["cluster"].dataType), StructField("key", StringType())])
    return rows.select("cluster", F.col("id").cast("string").alias("_id")).mapInArrow(run, out)


def cluster_records(assigned: DataFrame, edges: DataFrame, kind: str, rank: list[Column]) -> DataFrame:
    """cluster, key, members, representative, confidence, method of each cluster.

    assigned: id, cluster and what rank reads; edges: a, b, method, confidence. The key is that of cluster_keys(). The
    representative is first by rank, then by identifier. The confidence is the edges' mean, 0 without any; the method is the
    most frequent one, by name if several are, singleton without any.
    """
    c = F.col
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("members"))
    keys = cluster_keys(assigned, kind)
    heads = first_per_group(assigned, ["cluster"], [*rank, F.asc("id")]).select("cluster", c("id").alias("representative"))
    inside = edges.join(assigned.select(c("id").alias("a"), "cluster"), "a").groupBy("cluster", "method").agg(F.count("*").alias("_n"), F.sum("confidence").alias("_c"))
    means = inside.groupBy("cluster").agg((F.sum("_c") / F.sum("_n")).alias("_mean"), F.min(F.struct(-c("_n"), c("method").alias("m"))).alias("_modal"))
    out = sizes.join(keys, "cluster", "left").join(heads, "cluster").join(means, "cluster", "left")
    return out.select("cluster", F.coalesce("key", F.sha2(F.lit(kind), 256)).alias("key"), "members", "representative", F.coalesce("_mean", F.lit(0.0)).alias("confidence"), F.coalesce("_modal.m", F.lit("singleton")).alias("method"))
