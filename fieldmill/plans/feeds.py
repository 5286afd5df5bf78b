"""Queries of the gazetteer and of source adapters."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from fieldmill.functions.gazetteer import find_names, named_place, without_nested
from fieldmill.operators.components import shared_folder
from fieldmill.plans.catalogue import query
from fieldmill.sources import feeds
from fieldmill.sources.readers import table

#: Two gazetteers: words and phrases of benchmark items (names that documents have), and the names of parts, which stand in none.
NAMES = r"""names AS (SELECT DISTINCT item_id * 10 + k AS key, lower(array_to_string(w[3 * k + 1:3 * k + 1 + k % 3], ' ')) AS name FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark), range(0, 6) r(k) WHERE len(w) >= 3 * k + 1 + k % 3
  UNION SELECT 1000000 + p_partkey, p_name FROM part),
tok AS MATERIALIZED (SELECT doc_id, unnest(range(len(tok))) AS i, unnest(tok) AS t FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\pL\pN]+|[^\pL\pN]') AS tok FROM documents)),
grams AS (SELECT doc_id, unnest([t, t || lead(t, 1) OVER w || lead(t, 2) OVER w, t || lead(t, 1) OVER w || lead(t, 2) OVER w || lead(t, 3) OVER w || lead(t, 4) OVER w]) AS name FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT doc_id, name, count(*) AS n FROM grams WHERE name IN (SELECT name FROM names) GROUP BY ALL)"""


def _names(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)).alias("w"))
    k = F.col("k")
    cut = words.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).where(F.size("w") >= 3 * k + 1 + k % 3)
    phrases = cut.select((F.col("item_id") * 10 + k).alias("key"), F.expr("lower(array_join(slice(w, 3 * k + 1, 1 + k % 3), ' '))").alias("name"))
    return phrases.unionByName(table(spark, d, "part").select((F.lit(1_000_000) + F.col("p_partkey")).alias("key"), F.col("p_name").alias("name"))).distinct()


@query(f"WITH {NAMES} SELECT doc_id, key, n FROM hits JOIN names USING (name)")
def names_in_documents(spark, d):
    """How often each name of the gazetteers stands in each document."""
    return find_names(table(spark, d, "documents"), "doc_id", "text", _names(spark, d)).groupBy("doc_id", "key").agg(F.count("*").alias("n"))


@query(f"""WITH {NAMES}, f AS (SELECT doc_id, key, key // 100 AS place FROM hits JOIN names USING (name))
SELECT doc_id, CASE WHEN min(place) = max(place) THEN min(place) END AS place, count(DISTINCT place) AS places FROM f GROUP BY doc_id""")
def place_of_document(spark, d):
    """The place that all names of a document lie in; names of ten benchmark items make a place."""
    names = _names(spark, d)
    found = find_names(table(spark, d, "documents"), "doc_id", "text", names)
    return named_place(found, "doc_id", names.select("key", F.floor(F.col("key") / 100).alias("place")).distinct()).select("doc_id", "place", "places")


@query(f"""WITH {NAMES.replace(NAMES[: NAMES.index("tok AS")], "names AS (SELECT DISTINCT lower(array_to_string(w[1:3], ' ')) AS name FROM (SELECT regexp_extract_all(text, '[A-Za-z]+') AS w FROM benchmark) WHERE len(w) >= 3), ")}
SELECT doc_id, sum(n) AS whole FROM hits GROUP BY doc_id""")
def longest_names(spark, d):
    """Beginnings of benchmark items that documents repeat: of three words and all parts of them, only the whole beginning counts where it stands."""
    w = table(spark, d, "benchmark").select(F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), 1, 3).alias("w"))
    parts = F.explode(F.expr("flatten(transform(sequence(1, size(w)), i -> transform(sequence(1, size(w) - i + 1), n -> lower(array_join(slice(w, i, n), ' ')))))"))
    names = w.where(F.size("w") > 0).select(parts.alias("name")).distinct().select(F.col("name").alias("key"), "name")
    found = without_nested(find_names(table(spark, d, "documents"), "doc_id", "text", names), "doc_id")
    return found.where(F.size(F.split("key", " ")) == 3).groupBy("doc_id").agg(F.count("*").alias("whole"))


@query("SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, bit_xor(CAST(doc_id AS BIGINT)) AS ids FROM documents GROUP BY source")
def feed_read(spark, d):
    """Documents as lines of JSON by source, pulled through the adapter."""
    at = os.path.join(shared_folder(spark), f"feed-{uuid.uuid4().hex}")
    docs = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("external_id"), "text")
    docs.write.partitionBy("source").json(at)
    feeds.register(spark)
    rows = spark.read.format(feeds.NAME).option("path", at).load()
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.bit_xor(F.col("external_id").cast("long")).alias("ids"))
