"""Queries whose SQL states results by hand: a text for each remainder of an identifier, and what the function makes of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.functions import adverts, facts, geo, media, text
from fieldmill.operators import analytics, dedupe, matching, monitor, publication
from fieldmill.operators.shaping import spread
from fieldmill.plans.catalogue import QUERIES, SQL, query
from fieldmill.sources.readers import table


def _literal(value: object) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def stated(name: str, kind: str, apply: Callable[[Column], Column], *cases: tuple[str | None, object]) -> None:
    """Registers a query that applies a function to the texts of the cases, one for each part, and SQL with the stated results."""
    rows = ", ".join(f"({i}, CAST({_literal(value)} AS {kind}))" for i, (_, value) in enumerate(cases))
    SQL[name] = f"SELECT p_partkey AS id, v.value FROM part JOIN (VALUES {rows}) v(k, value) ON p_partkey % {len(cases)} = v.k"

    def run(spark: SparkSession, d: str) -> DataFrame:
        texts = F.array(*[F.lit(t).cast("string") for t, _ in cases])
        rows = spread(table(spark, d, "part")).select(F.col("p_partkey").alias("id"), F.get(texts, (F.col("p_partkey") % len(cases)).cast("int")).alias("_t"))
        return rows.select("id", apply(F.col("_t")).alias("value"))

    run.__name__ = name
    QUERIES[name] = run


stated("phone_numbers", "VARCHAR", text.phone_e164, ("012 345 678", "+85512345678"), ("+855 12 345 678", "+85512345678"), ("00855 96 123 4567", "+855961234567"), ("855 (0) 12-345-678", "+85512345678"), ("12345", None), ("+1 555 123 4567", None), (None, None))
stated("price_texts", "BIGINT", text.price_cents, ("$1,200.50 a month", 120050), ("850 USD", 85000), ("1.2k$ only", 120000), ("400000 riel", 10000), ("ask us", None), ("$2k", 200000), (None, None))
stated("bedroom_texts", "INTEGER", text.bedrooms, ("2 bedrooms and 1 bath", 2), ("Two-Bedroom flat", 2), ("2 bedrooms or 3 br", None), ("no rooms", None), ("10brs", 10), (None, None))
stated("bathroom_texts", "INTEGER", text.bathrooms, ("2 bedrooms and 1 bath", 1), ("three bathrooms", 3), ("1 bath, 2 bathrooms", None), ("bath", None))
stated("text_language", "VARCHAR", text.language, ("ផ្ទះជួល", "khmer"), ("Сдаётся дом 2", "cyrillic"), ("house 3", "latin"), ("hello привет", "mixed"), ("123 !", "unknown"))
stated("relative_ages", "BIGINT", text.relative_seconds, ("Just now", 0), ("3h", 10800), ("2 days ago", 172800), ("5 mins", 300), ("1 week", 604800), ("yesterday", None), ("45 sec ago", 45))
stated("budget_low", "BIGINT", lambda c: text.budget(c)["low"], ("200-400", 200), ("under 500", None), ("from $300", 300), ("200+", 200), ("$450", None), ("1,000 to 800", 800))
stated("budget_high", "BIGINT", lambda c: text.budget(c)["high"], ("200-400", 400), ("under 500", 500), ("from $300", None), ("200+", None), ("$450", 450), ("1,000 to 800", 1000))
stated("escaped_texts", "VARCHAR", text.html_escape, ("a < b & c > d", "a &lt; b &amp; c &gt; d"), ("&amp;", "&amp;amp;"), ("", ""), (None, None))
stated("head_tail_texts", "VARCHAR", lambda c: text.head_tail(c, 4, 3), ("abcdefghij", "abcd\n...\nhij"), ("abcdefg", "abcdefg"), ("", ""), (None, None))
stated("author_keys", "VARCHAR", lambda c: media.author_key(c, F.lit("Ann O'Neil ")), ("https://www.facebook.com/profile.php?id=A12&x=1", "fb:a12"), ("https://facebook.com/Some.One/", "facebook.com/some.one"), (" Plain  ID ", "plain id"), ("", "name:ann o neil"), (None, "name:ann o neil"))
stated("full_size_pictures", "VARCHAR", media.full_size, ("https://x.example/thumbs/a.jpg", "https://x.example/uploads/a.jpg"), ("https://x.example/s/a.jpg", "https://x.example/l/a.jpg"), ("https://x.example/m/s.jpg", "https://x.example/l/s.jpg"), ("https://x.example/a.jpg", "https://x.example/a.jpg"), (None, ""))
stated("picture_sets", "VARCHAR", lambda c: media.identity_hash(F.split(c, " ")), ("https://a.example/1.jpg?x=1 https://a.example/2.jpg", "7"), ("https://a.example/2.jpg https://a.example/1.jpg?y=2 https://a.example/1.jpg", "7"), ("none", None), (None, None))
SQL["picture_sets"] = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 2 THEN sha256('a.example/1.jpg' || chr(10) || 'a.example/2.jpg') END AS value FROM part"
stated("clean_pictures", "VARCHAR", lambda c: F.array_join(media.clean_photos(F.split(c, " ")), " "), ("https://a.example/1.jpg?a=1 https://a.example/1.jpg?b=2 https://a.example/2.jpg", "https://a.example/1.jpg?a=1 https://a.example/2.jpg"), ("ftp://a.example/1.jpg plain", ""), ("https://a.example/z.jpg https://a.example/b.jpg", "https://a.example/z.jpg https://a.example/b.jpg"), (None, None))
stated("city_status", "VARCHAR", lambda c: adverts.geography_status(c, ("riverton",), ("cambodia",)), ("Riverton town", "home"), ("Cambodia", "unknown"), ("Oakdale", "out_of_area"), (" ", "unknown"), (None, "unknown"))
stated("price_labels", "VARCHAR", lambda c: adverts.price_label(c.try_cast("long"), F.lit("USD")), ("120000", "$1,200"), ("0", "?"), (None, "?"), ("99900", "$999"))
stated("utility_labels", "VARCHAR", lambda c: adverts.utility_label(c, F.lit("$0.25")), ("included", "Included"), ("metered", "metered $0.25"), (None, "$0.25"))
stated("display_days", "VARCHAR", lambda c: adverts.display_day(c.cast("date"), F.lit("2024-03-01").cast("date")), ("2024-03-01", "Today"), ("2024-02-29", "Yesterday"), ("2024-02-28", "2024-02-28"), (None, None))
stated("iso_days", "DATE", facts.iso_date, ("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2024-2-9", None), ("2024-02-29T00", None), (None, None))
stated("grounded_numbers", "DOUBLE", lambda c: facts.grounded(F.lit(450.0), c), ("rent $450 now", 450), ("rent $1,450 now", None), ("450.0 a month", 450), ("none", None), (None, None))
stated("asking_amounts", "VARCHAR", lambda c: F.array_join(F.transform(facts.asking_prices(c), lambda x: x.cast("long").cast("string")), ","), ("Asking price: $350", "350"), ("asking price USD 1,200 then asking price $350", "350,1200"), ("price $350", ""), ("Asking price $400, asking price: $400", "400"))
stated("visit_seconds", "BIGINT", lambda c: monitor.adaptive_interval(F.split(c, "/")[0].cast("long"), F.split(c, "/")[1].cast("long")).cast("long"), ("600/2", 300), ("600/0", 1200), ("14000/0", 14400), ("300/0", 600))
stated("tag_lists", "VARCHAR", lambda c: F.array_join(publication.canonical_tags(F.split(c, ","), {"wi-fi": "Internet", "net": "Internet"}, ["Internet", "Pool", "Gym"]), ","), ("Wi-Fi,net, pool ", "Internet,Pool"), ("gym,sauna", "Gym"), ("sauna", ""), ("Pool,POOL", "Pool"))
stated("repeated_words_share", "DOUBLE", lambda c: F.round(matching.multiset_dice(F.split(F.split(c, "/")[0], " "), F.split(F.split(c, "/")[1], " ")), 6), ("a b b/a b c", 0.666667), ("a a a/a", 0.5), ("a b/a b", 1), ("a/b", 0), ("x x y/x x x y z", 0.75))
stated("picture_hash_matches", "VARCHAR", lambda c: _hash_match(c), ("1,255/3,254", "2 true"), ("1/3", "1 true"), ("1,65535/3,0", "1 false"), ("1/65535", "0 false"))


def _hash_match(c: Column) -> Column:
    """The case's two lists of hashes, matched within one bit."""
    side = lambda i: F.transform(F.split(F.split(c, "/")[i], ","), lambda x: x.cast("long"))
    m = matching.many_hashes(side(0), side(1), 1)
    return F.concat_ws(" ", m["matches"].cast("string"), m["same"].cast("string"))


@query("SELECT event_id, coalesce('tg:' || CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) END, 'user:' || CASE WHEN event_id % 3 = 1 THEN CAST(user_id AS VARCHAR) END, 'event:' || CAST(event_id AS VARCHAR)) AS actor FROM events")
def event_actors(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select("event_id", analytics.actor(F.when(k % 3 == 0, u), F.when(k % 3 == 1, u), k).alias("actor"))


@query("SELECT o_orderkey AS id, round(((s - floor(s)) * 2 - 1) * 0.003, 9) AS shift FROM (SELECT o_orderkey, sin(o_orderkey * 12.9898::DOUBLE) * 43758.5453 AS s FROM orders)")
def pin_jitter(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(geo.jitter(F.col("o_orderkey")), 9).alias("shift"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 10 > 0 THEN CAST(round(ln(p_retailprice) / ln(1.2::DOUBLE)) AS BIGINT) END AS bucket FROM part")
def price_buckets(spark, d):
    price = F.when(F.col("p_partkey") % 10 > 0, F.col("p_retailprice")).otherwise(0.0)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), dedupe.price_bucket(price).alias("bucket"))


@query("""SELECT id, CASE WHEN before > 0 AND price > 0 AND abs(before - price) <= 0.05 * before THEN 30 ELSE 0 END + CASE WHEN size = size_before THEN 25 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 15 ELSE 0 END + 20 AS score FROM
 (SELECT p_partkey AS id, p_retailprice AS price, p_size AS size, lag(p_retailprice) OVER w AS before, lag(p_size) OVER w AS size_before FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) WHERE before IS NOT NULL""")
def weighted_duplicates(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = table(spark, d, "part").select("*", F.lag("p_retailprice").over(w).alias("before"), F.lag("p_size").over(w).alias("size_before")).where("before IS NOT NULL")
    score = dedupe.weighted_score(F.col("before"), F.col("p_retailprice"), F.col("p_size") == F.col("size_before"), F.lit(True), F.col("p_partkey") % 3 == 0)
    return rows.select(F.col("p_partkey").alias("id"), score.alias("score"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(bit_count(xor(a.n_nationkey, b.n_nationkey)) AS INTEGER) AS distance FROM nation a, nation b WHERE bit_count(xor(a.n_nationkey, b.n_nationkey)) <= 1")
def audited_pairs(spark, d):
    hashes = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("long").alias("hash"))
    return matching.audit_pairs(hashes, hashes, 1)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 AND s >= 0.55 THEN 'source_url' WHEN o_orderkey % 3 > 0 AND o_orderkey % 100 <= 72 AND s >= 0.88 AND o_custkey % 9 >= 5 THEN 'identity_window' END AS method,
 CASE WHEN (o_orderkey % 4 = 0 AND s >= 0.55) OR (o_orderkey % 3 > 0 AND o_orderkey % 100 <= 72 AND s >= 0.88 AND o_custkey % 9 >= 5) THEN round(least(0.97, 0.72 + 0.28 * s), 6) END AS confidence
FROM (SELECT *, CAST(o_orderkey % 21 AS DOUBLE) / 20 AS s FROM orders)""")
def demand_rules(spark, d):
    k = F.col("o_orderkey")
    s = (k % 21).cast("double") / 20
    r = matching.demand_rule(s, k % 4 == 0, k % 3 > 0, k % 100, F.col("o_custkey") % 9)
    return table(spark, d, "orders").select(k.alias("id"), r["method"].alias("method"), F.round(r["confidence"], 6).alias("confidence"))


@query("""SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, CASE WHEN l_partkey % 5 = 0 THEN 'new' WHEN l_partkey % 7 = 0 OR NOT ((code AND (area OR beds OR kind)) OR (area AND beds AND kind)) THEN 'old' ELSE sha256('new|repurpose') END AS key
FROM (SELECT *, l_suppkey % 2 = 0 AS area, l_suppkey % 3 = 0 AS kind, l_linenumber % 4 >= 2 AS beds, l_orderkey % 6 = 0 AS code FROM lineitem)""")
def rebound_keys(spark, d):
    c = F.col
    old = F.when(c("l_partkey") % 5 == 0, None).otherwise("old")
    key = matching.rebound_key(F.lit("new"), old, c("l_partkey") % 7 == 0, c("l_suppkey") % 2 == 0, c("l_linenumber") % 4, c("l_suppkey") % 3 == 0, c("l_orderkey") % 6 == 0)
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("o"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), key.alias("key"))


# In each group of four pairs the best one ties up both its sides, so the worst one is left beside it.
@query("SELECT 2 * p_partkey + x AS a, 2 * p_partkey + x AS b, CAST(CASE x WHEN 0 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS score FROM part, (VALUES (0), (1)) v(x)")
def one_to_one_matches(spark, d):
    side = F.array(F.lit(0), F.lit(1))
    pairs = table(spark, d, "part").select("p_partkey", F.explode(side).alias("x")).select("*", F.explode(side).alias("y"))
    score = (9 - 2 * F.col("x") - F.col("y")) / 10
    return matching.one_to_one(pairs.select((2 * F.col("p_partkey") + F.col("x")).alias("a"), (2 * F.col("p_partkey") + F.col("y")).alias("b"), score.alias("score")))


@query("""WITH n AS (SELECT c_custkey AS id, min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 3) AS cluster, CASE WHEN c_custkey % 2 = 0 THEN min(c_custkey) OVER (PARTITION BY c_nationkey) + 1000000 END AS old FROM customer),
c AS (SELECT cluster, min(old) AS claim FROM n GROUP BY cluster), k AS (SELECT cluster, CASE WHEN claim IS NOT NULL AND row_number() OVER (PARTITION BY claim ORDER BY cluster) = 1 THEN claim END AS kept FROM c)
SELECT id, coalesce(kept, n.cluster) AS cluster FROM n JOIN k ON n.cluster = k.cluster""")
def kept_clusters(spark, d):
    rows, k = table(spark, d, "customer"), F.col("c_custkey")
    least = lambda *by: F.min("c_custkey").over(Window.partitionBy(*by))
    old = rows.select(k.alias("id"), (least("c_nationkey") + 1000000).alias("cluster")).where("id % 2 = 0")
    return matching.kept_cluster_ids(old, rows.select(k.alias("id"), least("c_nationkey", k % 3).alias("cluster")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 14 = 0 THEN 'o_orderstatus,o_totalprice' WHEN o_orderkey % 7 = 0 THEN 'o_orderstatus' ELSE 'o_totalprice' END AS changed FROM orders
WHERE (o_orderkey % 7 = 0) OR (o_orderkey % 2 = 0 AND o_orderkey % 10 > 0)""")
def scope_breaches(spark, d):
    before, k = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), F.col("o_orderkey")
    after = before.withColumn("o_totalprice", F.when(k % 2 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    out = matching.scope_violations(before, after, "o_orderkey", before.where(k % 10 == 0), ["o_orderstatus", "o_totalprice"], ["o_totalprice"])
    return out.select(k.alias("id"), "changed")


# Four hashes each of a document are one bit off it, so two bits from each other; others are far away.
@query("""WITH h AS (SELECT c_custkey AS id, xor(('0x' || substr(md5(CAST(c_custkey // 4 AS VARCHAR)), 1, 15))::BIGINT, CAST(1 << (c_custkey % 4) * 16 AS BIGINT)) AS hash FROM customer)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 5""")
def near_hash_pairs(spark, d):
    k = F.col("c_custkey")
    base = F.conv(F.substring(F.md5(F.floor(k / 4).cast("string")), 1, 15), 16, 10).cast("long")
    off = F.when(k % 4 == 0, 1).when(k % 4 == 1, 1 << 16).when(k % 4 == 2, 1 << 32).otherwise(1 << 48).cast("long")
    return dedupe.band_pairs(table(spark, d, "customer").select(k.alias("id"), base.bitwiseXOR(off).alias("hash")), 5)


# A customer's orders are a cluster, linked one after another.
@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS cluster, o_totalprice AS price, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
e AS (SELECT cluster, CASE id % 3 WHEN 0 THEN 'text_only' WHEN 1 THEN 'source_url' ELSE 'content_hash' END AS method, CAST(id % 8 AS DOUBLE) / 8 AS confidence FROM c WHERE b IS NOT NULL),
m AS (SELECT cluster, method, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, method) AS r FROM e GROUP BY cluster, method)
SELECT g.cluster, g.key, g.members, g.representative, coalesce(round(x.confidence, 9), 0) AS confidence, coalesce(m.method, 'singleton') AS method FROM
 (SELECT cluster, sha256('SUPPLY|' || string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS key, count(*) AS members, arg_min(id, (-price, id)) AS representative FROM c GROUP BY cluster) g
 LEFT JOIN (SELECT cluster, avg(confidence) AS confidence FROM e GROUP BY cluster) x ON x.cluster = g.cluster LEFT JOIN m ON m.cluster = g.cluster AND m.r = 1""")
def cluster_records(spark, d):
    k = F.col("id")
    w = Window.partitionBy("cluster").orderBy("id")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cluster"), F.col("o_totalprice").alias("price")).withColumn("b", F.lag("id").over(w))
    method = F.when(k % 3 == 0, "text_only").when(k % 3 == 1, "source_url").otherwise("content_hash")
    edges = rows.where("b IS NOT NULL").select(k.alias("a"), "b", method.alias("method"), ((k % 8).cast("double") / 8).alias("confidence"))
    out = dedupe.cluster_records(rows.drop("b"), edges, "SUPPLY", [F.desc("price")])
    return out.withColumn("confidence", F.round("confidence", 9))
