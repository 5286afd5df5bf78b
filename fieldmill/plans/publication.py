"""Queries of the operators of publication, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.operators import publication
from fieldmill.plans.catalogue import query
from fieldmill.sources.readers import table

OCCURRENCES = """WITH o AS (SELECT l_orderkey AS listing, l_partkey * 1000000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS id, l_partkey % 3 AS item,
 CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_partkey % 90 END AS published, l_partkey % 7 AS first_seen, l_suppkey % 100 AS last_seen,
 l_suppkey % 60 AS ended, CASE WHEN l_partkey % 5 = 0 THEN l_suppkey % 90 END AS changed, l_returnflag = 'N' AS is_current,
 l_linestatus = 'O' AS alive, CASE WHEN l_returnflag = 'R' THEN 'REMOVED' ELSE 'OK' END AS result FROM lineitem)
"""


@query(OCCURRENCES + """, f AS (SELECT o.*, row_number() OVER (PARTITION BY listing ORDER BY published NULLS LAST, first_seen NULLS FIRST, id) AS r FROM o)
SELECT listing, CASE WHEN NOT is_current AND NOT alive AND result = 'REMOVED' AND NOT EXISTS (SELECT 1 FROM o x WHERE x.listing = f.listing AND x.item = f.item AND x.is_current AND x.last_seen > f.ended) THEN false
 WHEN published IS NULL THEN true ELSE greatest(published, coalesce(changed, published)) >= 90 - 30 END AS eligible FROM f WHERE r = 1""")
def fresh_originals(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("listing"), (p * 1000000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"), (p % 3).alias("item"), F.when(p % 17 == 0, None).otherwise(p % 90).alias("published"), (p % 7).alias("first_seen"),
        (s % 100).alias("last_seen"), (s % 60).alias("ended"), F.when(p % 5 == 0, s % 90).alias("changed"), (F.col("l_returnflag") == "N").alias("is_current"), (F.col("l_linestatus") == "O").alias("alive"),
        F.when(F.col("l_returnflag") == "R", "REMOVED").otherwise("OK").alias("result"),
    )
    return publication.fresh_originals(rows, F.lit(90))


@query("""SELECT o_orderkey AS id FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE (o_orderstatus = 'O' AND coalesce(CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'rented' ELSE 'free' END, 'unknown') NOT IN ('rented', 'removed')
 AND o_custkey % 2 = 0 AND c_acctbal > 0 AND c_mktsegment <> 'BUILDING' AND o_orderdate >= TIMESTAMP '1995-01-01') OR o_orderkey % 1000 = 1""")
def public_eligibility(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("o_orderkey")
    free = F.when(k % 11 == 0, None).when(k % 7 == 0, "rented").otherwise("free")
    offer = F.when(F.col("c_mktsegment") == "BUILDING", "Sale").otherwise("rent")
    status = F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed")
    return o.where(publication.eligible(status, free, F.col("o_custkey") % 2 == 0, F.col("c_acctbal") > 0, offer, F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"), k % 1000 == 1)).select(k.alias("id"))


@query("SELECT s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE CASE WHEN s_nationkey % 3 <> 0 THEN CAST(s_nationkey AS VARCHAR) IN ('1', '4', '5') ELSE lower(trim(n_name)) IN (SELECT lower(n_name) FROM nation WHERE n_nationkey = 6) END")
def area_key_or_label(spark, d):
    n = table(spark, d, "nation")
    label = n.where("n_nationkey = 6").first()["n_name"]
    j = table(spark, d, "supplier").join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"))  # 25 nations
    key = F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey").cast("string"))
    return j.where(publication.in_area(key, F.col("n_name"), ["1", "4", "5"], [label])).select(F.col("s_suppkey").alias("id"))


@query("SELECT o_custkey AS id, o_orderkey AS item, precedence FROM (SELECT *, min(precedence) OVER (PARTITION BY o_custkey) AS least FROM (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS precedence FROM orders)) WHERE precedence = least")
def source_precedence(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("item"), "o_orderstatus")
    parts = [o.where(x).select("id", "item") for x in ("o_orderstatus = 'F'", "o_orderstatus = 'O'", "o_orderstatus NOT IN ('F', 'O')")]
    return publication.by_precedence(parts, "id")


@query("SELECT o_custkey % 10 AS area, o_orderkey AS id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 45 DAY) WHERE rank <= 50")
def recent_of_area(spark, d):
    o = table(spark, d, "orders").withColumn("area", F.col("o_custkey") % 10)
    now = F.lit(o.agg(F.max("o_orderdate").alias("x")).first()["x"]).cast("timestamp_ntz")
    return publication.recent_of_area(o, ["area"], "o_orderdate", now, 50, "o_orderkey").select("area", F.col("o_orderkey").alias("id"), "rank")


@query("SELECT user_id, c_custkey FROM events JOIN customer ON CASE WHEN event_id % 3 = 0 THEN 'canonical:' ELSE 'other:' END || CAST(user_id AS VARCHAR) = 'canonical:' || CAST(c_custkey AS VARCHAR)")
def typed_key_join(spark, d):
    e = table(spark, d, "events").select("user_id", F.concat(F.when(F.col("event_id") % 3 == 0, "canonical:").otherwise("other:"), F.col("user_id").cast("string")).alias("alias"))
    return publication.by_typed_key(e, table(spark, d, "customer").select("c_custkey"), "alias", "c_custkey", "canonical").select("user_id", "c_custkey")


@query("WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' || user_id || ' ' WHEN 1 THEN '-' || user_id WHEN 2 THEN user_id || '.5' WHEN 3 THEN '1e' || user_id % 400 ELSE 'x' END AS v FROM events) SELECT event_id, CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') AND TRY_CAST(trim(v) AS BIGINT) >= 0 THEN TRY_CAST(trim(v) AS BIGINT) * 100 END AS cents, CASE WHEN regexp_full_match(trim(v), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(trim(v) AS DOUBLE)) THEN TRY_CAST(trim(v) AS DOUBLE) END AS number FROM p")
def strict_numbers(spark, d):
    u, k = F.col("user_id"), F.col("event_id") % 5
    v = F.when(k == 0, F.concat(F.lit(" "), u, F.lit(" "))).when(k == 1, F.concat(F.lit("-"), u)).when(k == 2, F.concat(u, F.lit(".5"))).when(k == 3, F.concat(F.lit("1e"), u % 400)).otherwise("x")
    return table(spark, d, "events").select("event_id", publication.strict_integer(v, scale=100, most=(1 << 63) - 1).alias("cents"), publication.strict_decimal(v).alias("number"))


@query("""WITH RECURSIVE o AS (SELECT s_suppkey AS id, s_suppkey % 7 AS cost, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier WHERE s_suppkey % 7 > 0),
w AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS cost, CAST(60 AS BIGINT) AS left_, false AS taken
 UNION ALL SELECT o.r, o.id, o.cost, CASE WHEN o.cost <= left_ THEN left_ - o.cost ELSE left_ END, o.cost <= left_ FROM w JOIN o ON o.r = w.r + 1)
SELECT id, cost FROM w WHERE taken UNION ALL SELECT s_suppkey, 0 FROM supplier WHERE s_suppkey % 7 = 0""")
def greedy_budget(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 7).alias("cost"), "s_acctbal")
    return publication.greedy(rows, [F.desc("s_acctbal"), F.asc("id")], "cost", 60).select("id", "cost")


@query("SELECT CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' AND date_trunc('month', o_orderdate) = TIMESTAMP '1994-03-01' THEN o_orderkey % 9 END), 0) AS BIGINT) AS spent, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 9 END), 0) AS BIGINT) AS reserved FROM orders")
def budget_sums(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", (F.col("o_orderkey") % 9).alias("cost"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").alias("state"))
    return publication.budget_sums(o, "o_orderdate", "cost", "state", F.lit("1994-03-15").cast("timestamp_ntz"))


@query("SELECT event_type, n, recent FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) JOIN (SELECT event_type, string_agg(event_id, ',' ORDER BY r) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50 GROUP BY 1) USING (event_type)")
def demand_tallies(spark, d):
    out = publication.tallies_with_recent(table(spark, d, "events"), "event_type", "ts", "event_id", 50)
    return out.withColumn("recent", F.array_join(F.transform("recent", lambda x: x.cast("string")), ","))


@query("""WITH s AS (SELECT text, count(*) AS n, min(source) AS a, max(source) AS b, min(lang) AS m FROM documents GROUP BY text)
SELECT count(*) AS clusters, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS multi, CAST(sum(n - 1) AS BIGINT) AS collapsed, max(n) AS largest, count(*) FILTER (a <> b) AS cross_group,
 (SELECT string_agg(m || ':' || k, ',' ORDER BY m) FROM (SELECT m, count(*) AS k FROM s WHERE n > 1 GROUP BY m)) AS by_method FROM s""")
def repost_report(spark, d):
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("cluster"), F.col("doc_id").alias("id"), F.col("source").alias("grp"), "lang")
    methods = docs.groupBy("cluster").agg(F.min("lang").alias("method"), F.count("*").alias("_n")).where("_n > 1")
    return publication.repost_report(docs, methods)


@query("""WITH g AS (SELECT CAST(s_suppkey AS VARCHAR) AS url, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS priority, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey % 6 END AS seen, CASE WHEN s_suppkey % 10 > 0 THEN CAST(s_suppkey % 200 AS DOUBLE) END AS first,
 CASE WHEN s_suppkey % 10 > 0 THEN CAST(200 + s_suppkey % 90 AS DOUBLE) END AS last, CASE WHEN s_suppkey % 4 > 0 THEN CAST(s_suppkey % 16 AS DOUBLE) END AS rate, CASE WHEN s_suppkey % 7 = 0 THEN 'possible_gap' ELSE 'full' END AS coverage, CASE WHEN s_suppkey % 11 = 0 THEN 'non_chronological' ELSE 'ok' END AS ordering, s_suppkey % 5 AS demand, s_suppkey % 25 AS supply FROM supplier),
l AS (SELECT *, (coverage = 'possible_gap' OR ordering = 'non_chronological') AS odd, least(60, CASE WHEN coverage = 'possible_gap' OR ordering = 'non_chronological' THEN 80 ELSE 50 END) AS lim FROM g),
h AS (SELECT *, least(CASE WHEN seen IS NULL OR seen < 3 OR 300 - first < 72 THEN 12 ELSE 24 END, greatest(1, CASE WHEN rate > 0 THEN lim * 0.55 / rate ELSE 24 END)) AS h0 FROM l),
x AS (SELECT *, CASE WHEN odd THEN least(h0, 2) ELSE h0 END AS hours FROM h)
SELECT url, CAST(lim AS INTEGER) AS "limit", round(CAST(hours AS DOUBLE), 2) AS interval_hours, coalesce(300 - last - hours >= 0, true) AS due,
 CAST(floor(CASE priority WHEN 'A' THEN 30 WHEN 'B' THEN 20 ELSE 10 END + least(25, coalesce(rate, 0) * 2) + CASE WHEN coverage = 'possible_gap' THEN 50 ELSE 0 END + CASE WHEN ordering = 'non_chronological' THEN 30 ELSE 0 END + demand * 3 + least(15, supply)
 + CASE WHEN last IS NULL THEN 40 ELSE least(100, greatest(0, 300 - last - hours)) END + 0.5) AS BIGINT) AS score FROM x""")
def group_plan(spark, d):
    k = F.col("s_suppkey")
    known = lambda c: F.when(k % 10 > 0, c)
    groups = table(spark, d, "supplier").select(
        k.cast("string").alias("url"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C").alias("priority"), known(k % 6).alias("seen"), known((k % 200).cast("double")).alias("first"), known((200 + k % 90).cast("double")).alias("last"),
        F.when(k % 4 > 0, (k % 16).cast("double")).alias("rate"), F.when(k % 7 == 0, "possible_gap").otherwise("full").alias("coverage"), F.when(k % 11 == 0, "non_chronological").otherwise("ok").alias("ordering"), (k % 5).alias("demand"), (k % 25).alias("supply"),
    )
    return publication.plan_groups(groups, F.lit(300.0), 60).orderBy(F.desc("due"), F.desc("score"), "url")


@query("SELECT doc_id, trim(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', ' ', 'g')) AS place, length(trim(text)) > 0 AND length(regexp_replace(trim(text), '[^0-9]', '', 'g')) > 0.02 * length(trim(text)) AS heavy FROM (SELECT doc_id, source, lang, regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS text FROM documents)")
def place_and_script(spark, d):
    return table(spark, d, "documents").select("doc_id", publication.location_text(F.concat_ws(" / ", "source", "lang")).alias("place"), publication.script_share(F.col("text"), "0-9", 0.02).alias("heavy"))


@query("SELECT p_partkey AS id FROM part ORDER BY (p_size > 25) DESC, p_retailprice, p_partkey LIMIT 40")
def confidence_ties(spark, d):
    return table(spark, d, "part").orderBy((F.col("p_size") > 25).desc(), "p_retailprice", "p_partkey").limit(40).select(F.col("p_partkey").alias("id"))
