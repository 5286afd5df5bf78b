"""Queries of one-to-one matching, interval joins, mended clusters and deletes over a graph of tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmill.operators.components import _cut, near_components
from fieldmill.operators.pairing import SignalIndex, delete_closure, first_of_ranges, greedy_pairs, interval_join, mended_clusters
from fieldmill.operators.shaping import spread, star_links
from fieldmill.plans.catalogue import query
from fieldmill.sources.readers import table


@query("""WITH RECURSIVE g AS (SELECT l_suppkey AS a, l_partkey AS b, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
e AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS i FROM g WHERE score >= 1000),
m AS (SELECT a, b, score, i, [a] AS used_a, [b] AS used_b FROM e WHERE i = 1
  UNION ALL SELECT n.a, n.b, n.score, n.i, list_append(m.used_a, n.a), list_append(m.used_b, n.b)
  FROM m, LATERAL (SELECT * FROM e WHERE e.i > m.i AND NOT list_contains(m.used_a, e.a) AND NOT list_contains(m.used_b, e.b) ORDER BY e.i LIMIT 1) n)
SELECT a, b, score FROM m""")
def greedy_matching(spark, d):
    """Suppliers and parts, each in one pair at most, from the dearest line down."""
    return greedy_pairs(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_extendedprice").alias("score")), 1000)


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS id, o_custkey % 20 AS part, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_totalprice, o_orderkey) AS i FROM orders),
e AS (SELECT part, i, CASE WHEN i % 2 = 1 THEN id ELSE lead(id) OVER w END AS a, CASE WHEN i % 2 = 1 THEN lead(id) OVER w ELSE id END AS b, CAST(i AS DOUBLE) AS score FROM n WINDOW w AS (PARTITION BY part ORDER BY i)),
k AS (SELECT part, max(i) - 1 AS last FROM n GROUP BY part)
SELECT a, b, score FROM e JOIN k USING (part) WHERE i <= last AND (last - i) % 2 = 0""")
def chain_matching(spark, d):
    """Twenty chains: orders in order of price, each linked with the next one by a rising score. From the end of a chain every other link is taken."""
    w = Window.partitionBy("part").orderBy("o_totalprice", "o_orderkey")
    n = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 20).alias("part")).withColumn("i", F.row_number().over(w)).withColumn("next", F.lead("o_orderkey").over(w))
    odd = F.col("i") % 2 == 1
    e = n.select(F.when(odd, F.col("o_orderkey")).otherwise(F.col("next")).alias("a"), F.when(odd, F.col("next")).otherwise(F.col("o_orderkey")).alias("b"), F.col("i").cast("double").alias("score"))
    return greedy_pairs(e, 1.0)


#: Saved searches are customers: a range of prices around a multiple of the balance, some without an upper or a lower bound; every seventh user is not active, every fifth has paused.
SEARCHES = """searches AS (SELECT c_custkey AS filter_id, c_nationkey AS user_id, CASE WHEN c_custkey % 11 > 0 THEN abs(c_acctbal) * 40 END AS low, CASE WHEN c_custkey % 13 > 0 THEN abs(c_acctbal) * 40 + 2000 + c_custkey % 9 * 1500 END AS high,
  CASE c_mktsegment WHEN 'BUILDING' THEN '1-URGENT' WHEN 'AUTOMOBILE' THEN '2-HIGH' WHEN 'MACHINERY' THEN '3-MEDIUM' WHEN 'HOUSEHOLD' THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS kind FROM customer WHERE c_custkey % 7 > 0 AND c_nationkey % 5 > 0)"""


def _searches(spark, d):
    k, base = F.col("c_custkey"), F.abs("c_acctbal") * 40
    s = F.col("c_mktsegment")
    kind = F.when(s == "BUILDING", "1-URGENT").when(s == "AUTOMOBILE", "2-HIGH").when(s == "MACHINERY", "3-MEDIUM").when(s == "HOUSEHOLD", "4-NOT SPECIFIED").otherwise("5-LOW")
    c = table(spark, d, "customer").where((k % 7 > 0) & (F.col("c_nationkey") % 5 > 0))
    return c.select(k.alias("filter_id"), F.col("c_nationkey").alias("user_id"), F.when(k % 11 > 0, base).alias("low"), F.when(k % 13 > 0, base + 2000 + k % 9 * 1500).alias("high"), kind.alias("kind"))


def _offers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")


@query(f"WITH {SEARCHES} SELECT o_orderkey, user_id, min(filter_id) AS filter_id FROM orders JOIN searches ON o_orderpriority = kind AND (low IS NULL OR o_totalprice >= low) AND (high IS NULL OR o_totalprice <= high) GROUP BY ALL")
def first_saved_match(spark, d):
    """Each order and user with the first of the user's searches that it matches."""
    return first_of_ranges(_offers(spark, d), "o_orderkey", _searches(spark, d), [("o_orderpriority", "kind")], ["user_id"], "o_totalprice", "low", "high", "filter_id")


@query(f"""WITH {SEARCHES}, recent AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders QUALIFY r <= 500),
j AS (SELECT filter_id, o_orderkey, row_number() OVER (PARTITION BY filter_id ORDER BY r) AS rank, count(*) OVER (PARTITION BY filter_id) AS total FROM recent JOIN searches ON o_orderpriority = kind AND (low IS NULL OR o_totalprice >= low) AND (high IS NULL OR o_totalprice <= high))
SELECT filter_id, o_orderkey, rank, total FROM j WHERE rank BETWEEN 4 AND 6""")
def saved_search_page(spark, d):
    """The second page of three of each search, among the 500 newest orders of its kind, with the number of all matches there."""
    newest = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), "o_orderkey")
    recent = _offers(spark, d).withColumn("r", F.row_number().over(newest)).where("r <= 500")
    j = interval_join(recent, spread(_searches(spark, d), "filter_id"), [("o_orderpriority", "kind")], "o_totalprice", "low", "high", 5000.0)
    totals = j.groupBy("filter_id").agg(F.count("*").alias("total"))
    page = j.withColumn("rank", F.row_number().over(Window.partitionBy("filter_id").orderBy("r")).cast("long")).where("rank <= 6").where("rank >= 4")
    return page.join(totals, "filter_id").select("filter_id", "o_orderkey", "rank", "total")


def _signals(spark, d):
    """Events share a signal if they are of a user's day, or have a user's number and kind."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.to_date("ts").cast("string").alias("day"), F.get_json_object("props", "$.k").alias("k"), "event_type")
    return e.select("id", F.explode(F.array(F.concat_ws("|", F.lit("d"), "user_id", "day"), F.concat_ws("|", F.lit("k"), "user_id", "k", "event_type"))).alias("signal"))


@query("""WITH RECURSIVE s AS (SELECT event_id AS id, 'd|' || user_id || '|' || CAST(ts AS DATE) AS signal FROM events UNION SELECT event_id, 'k|' || user_id || '|' || json_extract_string(props, '$.k') || '|' || event_type FROM events),
p AS (SELECT DISTINCT m.id AS a, s.id AS b FROM s JOIN (SELECT signal, min(id) AS id FROM s GROUP BY signal) m USING (signal)), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT id, id AS reached FROM s UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reached)
SELECT id, min(least) AS cluster FROM (SELECT r.id, r.reached AS least FROM r) GROUP BY id""")
def mended_event_clusters(spark, d):
    """Clusters of the first 98 hundredths of events, mended when the others come; the same as clustering all of them at once."""
    index = SignalIndex(spark, _signals(spark, d))
    signals = index.rows()
    cut = (signals.agg(F.max("id")).first()[0] or 0) * 98 // 100
    before = signals.where(F.col("id") <= cut)
    of = near_components(star_links(before).withColumn("user", F.split_part("signal", F.lit("|"), F.lit(2))), "a", "b", "user")
    old = _cut(before.select("id").distinct().join(of, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster")))
    return mended_clusters(index, signals.where(F.col("id") > cut).select("id").distinct(), old)


REFERENCES = [
    ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("orders", "o_custkey", "customer"),
    ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_suppkey", "supplier"), ("orders", "o_before", "orders"),
]


@query("""WITH RECURSIVE o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS o_before FROM orders), n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1),
c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT * FROM n)),
g AS (SELECT o_orderkey FROM o WHERE o_custkey IN (SELECT * FROM c) UNION SELECT o.o_orderkey FROM o JOIN g ON o.o_before = g.o_orderkey AND o.o_orderkey <> g.o_orderkey),
l AS (SELECT 1 FROM lineitem WHERE l_orderkey IN (SELECT * FROM g) OR l_suppkey IN (SELECT * FROM s))
SELECT 'region' AS "table", CAST(1 AS BIGINT) AS n UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'supplier', count(*) FROM s
UNION ALL SELECT 'orders', count(*) FROM g UNION ALL SELECT 'lineitem', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_orderkey IN (SELECT * FROM g) OR l_suppkey IN (SELECT * FROM s)))""")
def delete_region(spark, d):
    """What goes with a region, by table; orders also hang on an earlier order, a line on its order and its supplier."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    k = F.col("o_orderkey")
    t["orders"] = t["orders"].withColumn("o_before", F.when((k % 3 == 0) & (F.floor(k / 2) != k), F.floor(k / 2)))
    t["lineitem"] = t["lineitem"].withColumn("key", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "key"}
    gone = delete_closure({"region": t["region"].where("r_regionkey = 1").select("r_regionkey")}, {n: (rows, keys[n]) for n, rows in t.items()}, REFERENCES)
    return gone.groupBy("table").agg(F.count("*").alias("n"))
