"""Text functions over whole columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.functions import adverts, facts, media, text
from fieldmill.operators import monitor
from fieldmill.plans.catalogue import query
from fieldmill.sources.readers import table


@query("SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN text[1:200] || chr(10) || '...' || chr(10) || text[length(text) - 99:] ELSE text END) AS value FROM documents")
def document_head_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.head_tail(F.col("text"), 200, 100)).alias("value"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS value FROM pages")
def page_escaped(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("value"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&[A-Za-z#0-9]+;', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'))) AS value FROM pages""")
def page_without_markup(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("value"))


@query(r"""SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN khmer > 0.6 * n THEN 'khmer' WHEN cyrillic > 0.6 * n THEN 'cyrillic' WHEN latin > 0.6 * n THEN 'latin' ELSE 'mixed' END AS value FROM
 (SELECT doc_id, length(regexp_replace(text, '[^\pL]', '', 'g')) AS n, length(regexp_replace(text, '[^\p{Khmer}]', '', 'g')) AS khmer, length(regexp_replace(text, '[^\p{Cyrillic}]', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS latin FROM documents)""")
def document_script(spark, d):
    return table(spark, d, "documents").select("doc_id", text.language(F.col("text")).alias("value"))


@query(r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+?[0-9][0-9() .-]{6,}[0-9]')) AS raw FROM documents), d AS (SELECT doc_id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM n),
o AS (SELECT doc_id, raw, regexp_replace(CASE WHEN d LIKE '00855%' THEN d[6:] WHEN d LIKE '855%' THEN d[4:] WHEN d LIKE '0%' THEN d[2:] END, '^0+', '') AS own FROM d)
SELECT doc_id, raw, CASE WHEN length(own) BETWEEN 8 AND 9 THEN '+855' || own END AS phone, count(*) AS n FROM o GROUP BY ALL""")
def document_phones(spark, d):
    """Every run of digits that may be a phone number, as it is written and in full."""
    raw = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\+?[0-9][0-9() .-]{6,}[0-9])"), F.lit(1))).alias("raw"))
    return raw.groupBy("doc_id", "raw", text.phone_e164(F.col("raw")).alias("phone")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN CAST(round(abs(c_acctbal) * 100) AS BIGINT) WHEN 1 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) * 100 WHEN 2 THEN CAST(round(floor(abs(c_acctbal)) * 100 / 4000) AS BIGINT) WHEN 3 THEN CAST(c_custkey % 9 + 1 AS BIGINT) * 100000 END AS cents FROM customer")
def balance_texts(spark, d):
    """Balances written in the ways of adverts and read back: dollars before and behind, riel, thousands, none."""
    k, n = F.col("c_custkey"), F.abs("c_acctbal")
    whole = F.floor(n).cast("string")
    t = F.when(k % 5 == 0, F.concat(F.lit("rent $ "), F.format_string("%.2f", n), F.lit(" a month"))).when(k % 5 == 1, F.concat(whole, F.lit(" USD"))).when(k % 5 == 2, F.concat(F.lit("only "), whole, F.lit(" riel"))).when(k % 5 == 3, F.concat(F.lit("$"), (k % 9 + 1).cast("string"), F.lit("k"))).otherwise(F.concat(F.lit("call "), F.col("c_name")))
    return table(spark, d, "customer").select(k.alias("id"), text.price_cents(t).alias("cents"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN n WHEN 1 THEN n * 60 WHEN 2 THEN n * 3600 WHEN 3 THEN n * 86400 WHEN 4 THEN n * 604800 END AS seconds FROM (SELECT o_orderkey, o_custkey % 90 AS n FROM orders)")
def order_ages(spark, d):
    k, n = F.col("o_orderkey"), (F.col("o_custkey") % 90).cast("string")
    words = {0: " sec ago", 1: " mins", 2: "h", 3: " Days ago", 4: " week", 5: " parts"}
    t = F.coalesce(*[F.when(k % 6 == i, F.concat(n, F.lit(w))) for i, w in words.items()])
    return table(spark, d, "orders").select(k.alias("id"), text.relative_seconds(t).alias("seconds"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN least(a, b) WHEN 2 THEN a WHEN 3 THEN a END AS low, CASE p_partkey % 5 WHEN 0 THEN greatest(a, b) WHEN 1 THEN a WHEN 4 THEN a END AS high FROM (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS a, CAST(p_size * 40 AS BIGINT) AS b FROM part)""")
def part_budgets(spark, d):
    """Both ends of budgets written as ranges, caps, floors and single amounts."""
    k, a, b = F.col("p_partkey"), F.floor("p_retailprice"), F.col("p_size") * 40
    t = F.when(k % 5 == 0, F.concat(F.lit("$"), F.format_number(a, 0), F.lit(" - "), b)).when(k % 5 == 1, F.concat(F.lit("Under $"), a)).when(k % 5 == 2, F.concat(F.lit("from "), F.format_number(a, 0))).when(k % 5 == 3, F.concat(a, F.lit("+"))).otherwise(F.concat(F.lit("$"), a))
    return table(spark, d, "part").select(k.alias("id"), text.budget(t)["low"].alias("low"), text.budget(t)["high"].alias("high"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 3 OR p_size % 13 = p_size % 9 THEN p_size % 13 END AS bedrooms, CASE WHEN p_partkey % 4 = 1 THEN p_size % 4 END AS bathrooms FROM part")
def part_rooms(spark, d):
    """Rooms named once, with baths, in two words, and in two mentions that may contradict each other."""
    k, n, m = F.col("p_partkey"), F.col("p_size") % 13, F.col("p_size") % 9
    t = F.when(k % 4 == 0, F.concat(F.lit("A house with "), n, F.lit(" bedrooms"))).when(k % 4 == 1, F.concat(n, F.lit(" BR and "), F.col("p_size") % 4, F.lit(" baths"))).when(k % 4 == 2, F.concat(n, F.lit("-bed room flat"))).otherwise(F.concat(n, F.lit(" beds or "), m, F.lit(" bedrooms")))
    return table(spark, d, "part").select(k.alias("id"), text.bedrooms(t).alias("bedrooms"), text.bathrooms(t).alias("bathrooms"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN '?' ELSE (CASE WHEN o_orderkey % 2 = 0 THEN '$' ELSE 'EUR ' END) || format('{:,}', CAST(round_even(round(o_totalprice * 100) / 100, 0) AS BIGINT)) END AS label FROM orders")
def order_price_labels(spark, d):
    k = F.col("o_orderkey")
    cents = F.when(k % 6 > 0, F.round(F.col("o_totalprice") * 100).cast("long"))
    return table(spark, d, "orders").select(k.alias("id"), adverts.price_label(cents, F.when(k % 2 == 0, "USD").otherwise("EUR")).alias("label"))


@query("SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-15' THEN 'Today' WHEN CAST(ts AS DATE) = DATE '2024-01-14' THEN 'Yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events")
def event_days(spark, d):
    return table(spark, d, "events").select("event_id", adverts.display_day(F.to_date("ts"), F.lit("2024-01-15").cast("date")).alias("day"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END END AS day FROM orders")
def order_days(spark, d):
    """Dates written in order, with day and month changed over, and with a time behind."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    t = F.when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "yyyy-dd-MM")).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH"))
    return table(spark, d, "orders").select(k.alias("id"), facts.iso_date(t).alias("day"))


@query(r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '') || lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')) AS author FROM pages""")
def page_author_keys(spark, d):
    return table(spark, d, "pages").select("page_id", media.author_key(F.col("url"), F.lit("nobody")).alias("author"))


@query("SELECT c_custkey AS id, CASE WHEN n_name = 'NATION_0' THEN 'unknown' WHEN contains(n_name, 'NATION_1') THEN 'home' ELSE 'out_of_area' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey")
def customer_area_status(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(F.col("c_custkey").alias("id"), adverts.geography_status(F.concat(F.col("n_name"), F.lit(" ")), ("nation_1",), ("nation_0",)).alias("status"))


@query("SELECT event_id, CAST(CASE WHEN value > 60 THEN 300 ELSE least(k * 300, 14400) END AS BIGINT) AS seconds FROM (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def event_intervals(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_id", monitor.adaptive_interval(k * 150, F.when(F.col("value") > 60, 1).otherwise(0)).cast("long").alias("seconds"))
