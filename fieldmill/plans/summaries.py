"""Queries of the smaller reports and filters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fieldmill.operators import predicates, summaries
from fieldmill.plans.catalogue import LISTINGS, listings, query
from fieldmill.plans.spec import NullPolicy, SearchSpec
from fieldmill.sources.readers import table

WANTED = "[" + ", ".join(str(i) for i in range(0, 30_000, 7)) + ', null, "x", 7]'


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey < 30000")
def orders_of_id_set(spark, d):
    """Some four thousand identifiers in one JSON parameter."""
    return summaries.in_id_set(table(spark, d, "orders"), "o_orderkey", WANTED).select("o_orderkey")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate AS posted, CASE WHEN o_orderkey % 400 > 0 THEN TIMESTAMP '2001-01-01' - to_hours(o_orderkey % 193) END AS checked FROM orders),
a AS (SELECT *, epoch(TIMESTAMP '2001-01-01') - epoch(posted) AS age, epoch(TIMESTAMP '2001-01-01') - epoch(checked) AS wait FROM o)
SELECT o_orderkey FROM a WHERE checked IS NULL OR wait >= 3600 * CASE WHEN age <= 7 * 86400 THEN 12 WHEN age <= 30 * 86400 THEN 72 ELSE 168 END ORDER BY checked NULLS FIRST, o_orderkey LIMIT 200""")
def due_for_check(spark, d):
    now = F.lit("2001-01-01 00:00:00").cast("timestamp")
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("posted"), F.when(k % 400 > 0, F.timestamp_seconds(F.unix_seconds(now) - k % 193 * 3600)).alias("checked"))
    return summaries.due_for_check(rows, "posted", "checked", "o_orderkey", now, 200).select("o_orderkey")


@query(LISTINGS + """, p AS (SELECT *, CASE WHEN price > 0 THEN price END AS known FROM listings)
SELECT 'category' AS facet, category AS value, count(*) AS n, CAST(NULL AS BIGINT) AS low, CAST(NULL AS BIGINT) AS high FROM p GROUP BY category UNION ALL SELECT 'bedrooms', CAST(bedrooms AS VARCHAR), count(*), NULL, NULL FROM p WHERE bedrooms IS NOT NULL GROUP BY bedrooms
UNION ALL SELECT 'price', NULL, count(*), coalesce(min(known), 0), coalesce(max(known), 0) FROM p""")
def facets_in_one_pass(spark, d):
    return summaries.facets(listings(spark, d), ["category", "bedrooms"], "price")


@query("""WITH e AS (SELECT ts, unnest(['CODE_' || k % 11 || ':' || event_type, 'EXTRA_' || user_id % 13]) AS c FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)), m AS (SELECT max(ts) AS now FROM events),
n AS (SELECT split_part(c, ':', 1) AS code, count(*) AS a, count(*) FILTER (ts > now - INTERVAL 24 HOUR) AS b FROM e, m GROUP BY 1)
SELECT 'all' AS period, row_number() OVER (ORDER BY a DESC, code) AS rank, code, a AS n FROM n QUALIFY rank <= 8 UNION ALL SELECT 'day', row_number() OVER (ORDER BY b DESC, code) AS rank, code, b FROM n WHERE b > 0 QUALIFY rank <= 10""")
def warning_histogram(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    codes = F.array(F.concat(F.lit("CODE_"), k % 11, F.lit(":"), F.col("event_type")), F.concat(F.lit("EXTRA_"), F.col("user_id") % 13))
    last = e.agg(F.max("ts").alias("now"))
    rows = e.withColumn("codes", codes).crossJoin(F.broadcast(last))  # one row
    return summaries.warning_histogram(rows, "codes", "ts", F.col("now"))


@query("""SELECT CASE WHEN n IS NULL THEN 'unresolved' ELSE 'mapped' END AS state, c_custkey, n AS targets, low AS least, high AS greatest FROM customer LEFT JOIN
 (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def mapped_customers(spark, d):
    """Customers with their urgent open orders, and those without, kept apart."""
    urgent = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    mapped, left = summaries.mapped_and_unresolved(table(spark, d, "customer").select("c_custkey"), urgent, "c_custkey", "o_orderkey")
    none = F.lit(None).cast("long")
    return mapped.select(F.lit("mapped").alias("state"), "c_custkey", "targets", "least", "greatest").unionByName(left.select(F.lit("unresolved").alias("state"), "c_custkey", none.alias("targets"), none.alias("least"), none.alias("greatest")))


@query("""SELECT CASE WHEN e IS NULL AND a IS NULL THEN 'unknown_preserved' WHEN e IS NULL THEN 'unverified' WHEN a IS NULL THEN 'missed' WHEN e = a THEN 'correct' ELSE 'contradicted' END AS outcome, count(*) AS n
FROM (SELECT quality AS e, CASE WHEN n_chars % 5 > 0 THEN CASE WHEN n_chars >= 600 THEN 1 ELSE 0 END END AS a FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def extraction_outcomes(spark, d):
    """Labels of quality against a guess from the length, which knows nothing of every fifth length; documents without a label state nothing."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    guess = F.when(F.col("n_chars") % 5 > 0, F.when(F.col("n_chars") >= 600, 1).otherwise(0))
    return j.groupBy(summaries.confusion(F.col("quality"), guess).alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, user_id, event_id * 7919 % 10007 AS arrival, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events),
b AS (SELECT *, max(day) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT event_id, CASE WHEN day = before THEN 'duplicate' WHEN day < before THEN 'stale' ELSE 'applied' END AS disposition FROM b""")
def observation_dispositions(spark, d):
    """Days on which a user was observed, arriving in a scrambled order."""
    k = F.col("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", F.struct((k * 7919 % 10007).alias("a"), k).alias("arrival"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day"))
    return summaries.dispositions(e, "user_id", "arrival", "day").select("event_id", "disposition")


@query(LISTINGS + "SELECT CAST(NULL AS BIGINT) AS id, count(*) AS total FROM listings WHERE bedrooms >= 4 AND price BETWEEN 91000 AND 92500")
def total_of_an_empty_page(spark, d):
    """A page behind the last match still has the total."""
    spec = SearchSpec(NullPolicy.LEGACY, bedrooms=(4,), min_price=91000, max_price=92500, offset=50_000, columns={"date": "day"})
    rows = listings(spark, d)
    behind = max(spec.offset, predicates.total(rows, spec).first()["total"])
    return summaries.searched(rows, replace(spec, offset=behind)).select("id", "total")
