"""Queries of the funnel report, and of search filters that no other query uses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fieldmill.operators import analytics, predicates
from fieldmill.operators.report import funnel_report
from fieldmill.plans.catalogue import LISTINGS, listings, query
from fieldmill.plans.spec import NullPolicy, SearchSpec
from fieldmill.sources.readers import table

BEGIN, END, INTERNAL = datetime(2024, 1, 5), datetime(2024, 1, 25, 12), ["user:3", "user:7"]

FUNNEL = """e AS (SELECT event_id AS id, 'user:' || user_id AS actor, CASE WHEN k % 10 < 9 THEN 'ref' || k % 10 END AS item, CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'interest' WHEN 'signup' THEN 'grant' WHEN 'purchase' THEN 'dispatch' END AS kind, ts AS tm,
  CASE k % 5 WHEN 1 THEN '{}' WHEN 2 THEN '{"area": "a' || k || '"}' WHEN 3 THEN '[' || k || ']' WHEN 4 THEN '{"area": "", "beds": null}' END AS context FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25 12:00:00' AND user_id NOT IN (3, 7) AND event_type <> 'error'),
c AS (SELECT count(DISTINCT actor) FILTER (kind = 'view') AS uv, count(DISTINCT item) FILTER (kind = 'view') AS iv, count(*) FILTER (kind = 'view') AS v, count(DISTINCT actor) FILTER (kind = 'interest') AS ui, count(DISTINCT item) FILTER (kind = 'interest') AS ii,
  count(*) FILTER (kind = 'interest') AS i, count(DISTINCT actor) FILTER (kind = 'dispatch') AS ud, count(DISTINCT item) FILTER (kind = 'dispatch') AS id, count(*) FILTER (kind = 'dispatch') AS d, count(*) FILTER (kind = 'grant') AS g FROM e),
b AS (SELECT (SELECT count(*) FROM (SELECT actor FROM e WHERE kind = 'view' INTERSECT SELECT actor FROM e WHERE kind = 'interest')) AS users, (SELECT count(*) FROM (SELECT item FROM e WHERE kind = 'view' AND item IS NOT NULL INTERSECT SELECT item FROM e WHERE kind = 'interest')) AS items),
p AS (SELECT actor, item, count(*) AS n FROM e WHERE kind = 'dispatch' AND item IS NOT NULL GROUP BY ALL), u AS (SELECT actor, count(*) AS n FROM e WHERE kind = 'interest' GROUP BY actor),
x AS (SELECT CASE k WHEN 0 THEN 'direct' WHEN 1 THEN 'broad' WHEN 2 THEN 'filtered' WHEN 3 THEN 'invalid' ELSE 'broad' END AS c FROM (SELECT CASE WHEN context IS NULL THEN 0 WHEN context = '{}' THEN 1 WHEN context LIKE '{"area": "a%' THEN 2 WHEN context LIKE '[%' THEN 3 ELSE 4 END AS k FROM e WHERE kind = 'interest')),
t AS (SELECT i.id, (epoch_us(i.tm) - epoch_us(max(v.tm))) / 1e6 AS gap FROM e i JOIN e v ON v.actor = i.actor AND v.item = i.item AND v.kind = 'view' AND v.tm <= i.tm WHERE i.kind = 'interest' GROUP BY i.id, i.tm),
r AS (SELECT 'funnel' AS section, unnest(['view_users', 'view_items', 'view_events', 'interest_users', 'interest_items', 'interest_events', 'dispatch_users', 'dispatch_items', 'dispatch_events', 'view_to_interest_user_rate', 'viewed_to_interested_item_rate', 'grants_per_interest']) AS name,
    unnest([uv, iv, v, ui, ii, i, ud, id, d, round(100.0 * users / nullif(uv, 0), 2), round(100.0 * items / nullif(iv, 0), 2), round(100.0 * g / nullif(i, 0), 2)]::DOUBLE[]) AS value, unnest(range(1, 13)) AS rank FROM c, b
  UNION ALL SELECT 'dispatch', unnest(['pairs', 'repeat_events', 'pairs_with_repeats']), unnest([count(*), coalesce(sum(n), 0) - count(*), count(*) FILTER (n > 1)]::DOUBLE[]), unnest([1, 2, 3]) FROM p
  UNION ALL SELECT 'repeated_pairs', actor || '|' || item, n, row_number() OVER (ORDER BY n DESC, actor || '|' || item) FROM p WHERE n > 1
  UNION ALL SELECT 'interests_per_user', unnest(['one', 'several', 'average', 'most']), unnest([count(*) FILTER (n = 1), count(*) FILTER (n > 1), round(avg(n), 2), coalesce(max(n), 0)]::DOUBLE[]), unnest([1, 2, 3, 4]) FROM u
  UNION ALL SELECT 'context', unnest(['direct', 'broad', 'filtered', 'invalid']), unnest([count(*) FILTER (c = 'direct'), count(*) FILTER (c = 'broad'), count(*) FILTER (c = 'filtered'), count(*) FILTER (c = 'invalid')]::DOUBLE[]), unnest([1, 2, 3, 4]) FROM x
  UNION ALL SELECT 'top_items', item, count(*), row_number() OVER (ORDER BY count(*) DESC, item) FROM e WHERE kind = 'interest' AND item IS NOT NULL GROUP BY item
  UNION ALL SELECT 'view_to_interest', unnest(['matched', 'unmatched', 'median_seconds']), unnest([count(*), (SELECT i FROM c) - count(*), round(median(gap), 1)]::DOUBLE[]), unnest([1, 2, 3]) FROM t)"""


def _funnel_events(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "click", "interest").when(F.col("event_type") == "signup", "grant").when(F.col("event_type") == "purchase", "dispatch")
    context = F.when(k % 5 == 1, "{}").when(k % 5 == 2, F.concat(F.lit('{"area": "a'), k, F.lit('"}'))).when(k % 5 == 3, F.concat(F.lit("["), k, F.lit("]"))).when(k % 5 == 4, '{"area": "", "beds": null}')
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), analytics.actor(F.lit(None).cast("long"), F.col("user_id"), F.col("event_id")).alias("actor"), F.when(k % 10 < 9, F.concat(F.lit("ref"), k % 10)).alias("item"), kind.alias("kind"), F.col("ts").alias("at"), context.alias("context"))


@query(f"WITH {FUNNEL} SELECT section, CAST(rank AS BIGINT) AS rank, name, CAST(value AS DOUBLE) AS value FROM r WHERE rank <= 10 OR section = 'funnel'")
def funnel_report_whole(spark, d):
    """Twenty and a half days, two internal actors left out."""
    return funnel_report(_funnel_events(spark, d), BEGIN, END, INTERNAL)


@query(LISTINGS + "SELECT id, price FROM listings WHERE price >= 91000 AND price <= 92500")
def price_range_legacy(spark, d):
    """Known prices inside the range, and no others."""
    return listings(spark, d).where(predicates.where(SearchSpec(NullPolicy.LEGACY, 91000, 92500))).select("id", "price")


@query(LISTINGS + "SELECT id, price FROM listings WHERE price IS NULL OR price <= 0 OR price BETWEEN 91000 AND 92500")
def price_range_canonical(spark, d):
    """The same with unknown prices."""
    return listings(spark, d).where(predicates.where(SearchSpec(NullPolicy.CANONICAL, 91000, 92500))).select("id", "price")


@query(LISTINGS + "SELECT id, lat, lng FROM listings WHERE lat BETWEEN -84 AND 84 AND lng BETWEEN -154 AND 154")
def box_with_overscan(spark, d):
    """Corners in any order, padded by a fifth of the extent on each side."""
    return listings(spark, d).where(predicates.where(SearchSpec(bounds=(60.0, 110.0, -60.0, -110.0)))).select("id", "lat", "lng")


@query(LISTINGS + "SELECT id, category FROM listings WHERE contains(lower(category), '#1') OR contains(lower(category), 'd#22')")
def search_locations(spark, d):
    spec = SearchSpec(locations=("#1", "D#22"), columns={"location": "category"})
    return listings(spark, d).where(predicates.where(spec)).select("id", "category")


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, ' '), lambda w: lower(w) = 'the')) > 0")
def has_word(spark, d):
    return table(spark, d, "documents").where(predicates.has_member(F.split("text", " "), "THE")).select("doc_id")


@query("SELECT event_id FROM events WHERE json_extract_string(json_object('open', CAST(props->>'$.k' AS BIGINT) % 2 = 0), '$.open') = 'true'")
def json_flag(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    flag = F.to_json(F.struct((k % 2 == 0).alias("open")))
    return table(spark, d, "events").where(predicates.json_flag(flag, "$.open")).select("event_id")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def anti_missing_urgent(spark, d):
    """Customers without an urgent open order."""
    urgent = table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")
