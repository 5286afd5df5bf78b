"""Queries of the operators whose rows depend on what came before them: ingest, outbox, leases, limits, pacing, crawl memory."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from fieldmill.operators.components import shared_folder
from fieldmill.operators.ordered import Leases, Limits, admit, crawl_memory, lease_log, outbox, paced
from fieldmill.plans.catalogue import query
from fieldmill.sources.readers import table
from fieldmill.streaming.ingest import ItemTable


def _posts(spark, d):
    """Events as observations of posts: an item is a kind and a number, its text and pictures change with value and user."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("source"),
        F.get_json_object("props", "$.k").alias("external_id"),
        F.floor(F.col("value") / 20).cast("string").alias("content_hash"),
        F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 2).cast("string")).alias("media_hash"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("payload"),
    )


POSTS = """posts AS (SELECT event_type AS source, json_extract_string(props, '$.k') AS external_id, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS content_hash,
  CASE WHEN user_id % 3 > 0 THEN CAST(user_id % 2 AS VARCHAR) END AS media_hash, ts AS observed_at, event_id AS seq, value AS payload FROM events),
marked AS (SELECT *, row_number() OVER w = 1 OR content_hash IS DISTINCT FROM lag(content_hash) OVER w OR media_hash IS DISTINCT FROM lag(media_hash) OVER w AS changed, row_number() OVER w = 1 AS first
  FROM posts WINDOW w AS (PARTITION BY source, external_id ORDER BY seq))"""


def _ingested(spark, d):
    """A table after four batches, the third of them delivered twice."""
    posts = _posts(spark, d)
    items = ItemTable(spark, os.path.join(shared_folder(spark), f"ingest-{uuid.uuid4().hex}"), payload=["payload"], buckets=16)
    end = (posts.agg(F.max("seq")).first()[0] or 0) + 1
    cuts = [end * i // 4 for i in range(5)]
    for batch in (0, 1, 2, 2, 3):
        items.merge(posts.where((F.col("seq") >= cuts[batch]) & (F.col("seq") < cuts[batch + 1])), batch)
    return items, posts


@query(f"""WITH {POSTS} SELECT source, external_id, arg_max(content_hash, seq) FILTER (content_hash IS NOT NULL) AS content_hash, first(media_hash ORDER BY seq DESC) AS media_hash,
  arg_max(payload, seq) FILTER (changed) AS payload, count(*) FILTER (changed) AS version, epoch_us(min(observed_at)) AS first_seen, epoch_us(max(observed_at)) AS last_seen FROM marked GROUP BY source, external_id""")
def ingested_items(spark, d):
    items, posts = _ingested(spark, d)
    return items.items(posts).select("source", "external_id", "content_hash", "media_hash", "payload", "version", F.unix_micros("first_seen").alias("first_seen"), F.unix_micros("last_seen").alias("last_seen"))


@query(f"""WITH {POSTS} SELECT source, CASE WHEN NOT changed THEN 'unchanged' WHEN first THEN 'new' ELSE 'updated' END AS status, count(*) AS n FROM marked GROUP BY ALL""")
def ingest_report(spark, d):
    items, _ = _ingested(spark, d)
    return items.outcomes().groupBy("source", "status").agg(F.count("*").alias("n"))


HOUR = 3_600_000_000
#: Searches of a user: two in any six hours, three in any day; for the other query two a day by the clocks of a place whose time is eight hours behind in the table's months.
ROLLING, CALENDAR = Limits(rolling=((2, 21_600), (3, 86_400))), Limits(rolling=(), daily=((2, "America/Los_Angeles"),))

ATTEMPTS = "e AS (SELECT user_id, event_id, epoch_us(ts) AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(ts - INTERVAL 8 HOUR AS DATE) AS day FROM events)"


@query(f"""WITH RECURSIVE {ATTEMPTS}, s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS tm, CAST([] AS BIGINT[]) AS times, CAST(NULL AS VARCHAR) AS refused_by FROM e
  UNION ALL SELECT user_id, i, event_id, tm, CASE WHEN refused IS NULL THEN list_append(times, tm) ELSE times END, refused FROM (
    SELECT e.*, s.times, CASE WHEN len(list_filter(s.times, lambda x: e.tm - x < 6 * {HOUR})) >= 2 THEN '2 in 21600 s' WHEN len(list_filter(s.times, lambda x: e.tm - x < 24 * {HOUR})) >= 3 THEN '3 in 86400 s' END AS refused
    FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, event_id AS id, tm AS "at", refused_by IS NULL AS admitted, refused_by FROM s WHERE i > 0""")
def admitted_searches(spark, d):
    return admit(table(spark, d, "events"), ["user_id"], "event_id", "ts", ROLLING)


@query(f"WITH {ATTEMPTS} SELECT user_id, event_id AS id, tm AS \"at\", n <= 2 AS admitted, CASE WHEN n > 2 THEN '2 a day in America/Los_Angeles' END AS refused_by FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY i) AS n FROM e)")
def admitted_by_calendar_day(spark, d):
    return admit(table(spark, d, "events"), ["user_id"], "event_id", "ts", CALENDAR)


#: Jobs of users: what the kinds of events stand for; a write or failure shows the token k % 12.
JOB_KINDS = {"signup": "enqueue", "view": "claim", "click": "write", "error": "fail", "purchase": "claim"}
LEASES = Leases(lease=30 * HOUR, back_off=2 * HOUR, most=3)


def _jobs(spark, d):
    e = table(spark, d, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in JOB_KINDS.items()])
    return e.select("user_id", "event_id", "ts", kind.alias("kind"), (F.get_json_object("props", "$.k").cast("long") % 12).alias("shown"))


LEASE_LOG = f"""e AS (SELECT user_id, event_id, epoch_us(ts) AS tm, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'click' THEN 'write' WHEN 'error' THEN 'fail' ELSE 'claim' END AS kind,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS shown, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS tm, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS token, CAST(NULL AS BIGINT) AS until,
      CAST(0 AS BIGINT) AS attempts, CAST(NULL AS BIGINT) AS retry, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS over FROM e
    UNION ALL SELECT user_id, i, event_id, tm,
      CASE outcome WHEN 'queued' THEN 'queued' WHEN 'failed' THEN 'failed' WHEN 'claimed' THEN 'running' WHEN 'accepted' THEN 'done' WHEN 'retry' THEN 'queued' ELSE status END,
      CASE outcome WHEN 'claimed' THEN token + 1 ELSE token END, CASE WHEN outcome = 'claimed' THEN tm + 30 * {HOUR} WHEN outcome IN ('ignored', 'refused') THEN until END,
      CASE outcome WHEN 'queued' THEN 0 WHEN 'claimed' THEN attempts + 1 ELSE attempts END, CASE WHEN outcome = 'retry' THEN tm + 2 * {HOUR} * attempts WHEN outcome IN ('ignored', 'refused', 'claimed') THEN retry END, outcome, over
    FROM (SELECT *, CASE WHEN kind = 'enqueue' AND (status IS NULL OR status IN ('done', 'failed')) THEN 'queued'
        WHEN kind = 'claim' AND status = 'queued' AND (retry IS NULL OR retry <= tm) THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'claimed' END
        WHEN kind = 'write' THEN CASE WHEN status = 'running' AND shown = token THEN 'accepted' ELSE 'refused' END
        WHEN kind = 'fail' THEN CASE WHEN NOT coalesce(status = 'running' AND shown = token, false) THEN 'refused' WHEN attempts >= 3 THEN 'failed' ELSE 'retry' END ELSE 'ignored' END AS outcome
      FROM (SELECT e.*, CASE WHEN s.status = 'running' AND s.until <= e.tm THEN 'queued' ELSE s.status END AS status, s.token, CASE WHEN s.status = 'running' AND s.until > e.tm THEN s.until END AS until, s.attempts,
          CASE WHEN s.status = 'running' AND s.until <= e.tm THEN NULL ELSE s.retry END AS retry, CASE WHEN s.status = 'running' AND s.until <= e.tm THEN s.until END AS over FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)))"""


@query(f"WITH RECURSIVE {LEASE_LOG} SELECT user_id, event_id AS id, tm AS \"at\", outcome, token, attempts FROM s WHERE i > 0 UNION ALL SELECT n.user_id, NULL, n.over, 'expired', p.token, p.attempts FROM s n JOIN s p ON p.user_id = n.user_id AND p.i = n.i - 1 WHERE n.over IS NOT NULL")
def lease_outcomes(spark, d):
    return lease_log(_jobs(spark, d), "user_id", "event_id", "ts", "kind", "shown", LEASES)


@query("""WITH RECURSIVE p AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS sample, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, min(event_id) AS first FROM events GROUP BY ALL),
  c AS (SELECT event_type, sample, list(k ORDER BY first) AS ids, row_number() OVER (PARTITION BY event_type ORDER BY sample) AS i FROM p GROUP BY event_type, sample),
  s AS (SELECT DISTINCT event_type, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS sample, CAST([] AS BIGINT[]) AS mem, CAST(0 AS BIGINT) AS new, CAST(0 AS BIGINT) AS known, CAST(0 AS BIGINT) AS forgotten FROM c
    UNION ALL SELECT event_type, i, sample, list_concat(mem, fresh)[greatest(1, len(mem) + len(fresh) - 59):], len(fresh), len(ids) - len(fresh), greatest(0, len(mem) + len(fresh) - 60)
    FROM (SELECT c.*, s.mem, list_filter(c.ids, lambda x: NOT list_contains(s.mem, x)) AS fresh FROM s JOIN c ON c.event_type = s.event_type AND c.i = s.i + 1))
SELECT event_type, sample, new, known, forgotten, len(mem) AS held FROM s WHERE i > 0""")
def crawl_memory_samples(spark, d):
    """Each day's numbers of a kind of event as a crawl of its source; the memory holds 60."""
    return crawl_memory(_samples(table(spark, d, "events")), "event_type", "sample", "ids", 60)


def _samples(events):
    e = events.select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (24 * HOUR)).alias("sample"), F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")
    firsts = e.groupBy("event_type", "sample", "k").agg(F.min("event_id").alias("_first"))
    return firsts.groupBy("event_type", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "k"))), lambda x: x["k"]).alias("ids"))


#: Deliveries by user and number modulo 8: a sign-up approves, a view claims, a purchase acknowledges; a claim is stale after three days.
STALE, HIGH_WATER = 72 * HOUR, 500


def _deliveries(events):
    kind = F.when(F.col("event_type") == "signup", "approve").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "purchase", "ack")
    return events.select("user_id", (F.get_json_object("props", "$.k").cast("long") % 8).alias("item"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind")).where("kind IS NOT NULL")


@query(f"""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS item, epoch_us(ts) AS tm, event_id AS id, event_type AS kind, (SELECT epoch_us(max(ts)) FROM events) AS now FROM events),
  a AS (SELECT user_id, item, min((tm, id)) AS a FROM e WHERE kind = 'signup' AND id > {HIGH_WATER} GROUP BY ALL),
  c AS (SELECT user_id, item, a, min((tm, id)) FILTER (kind = 'view' AND (tm, id) > a) AS c, any_value(now) AS now FROM a JOIN e USING (user_id, item) GROUP BY ALL),
  f AS (SELECT user_id, item, a, c, c.now AS now, count(*) FILTER (kind = 'purchase') AS n, min((tm, id)) FILTER (kind = 'purchase' AND (tm, id) > c) AS s FROM c JOIN e USING (user_id, item) GROUP BY ALL),
  t AS (SELECT *, coalesce(s[1] - c[1] <= {STALE}, false) AS sent FROM f)
SELECT user_id, item, CASE WHEN sent THEN 'sent' WHEN c[1] + {STALE} < now THEN 'uncertain' WHEN c IS NOT NULL THEN 'sending' ELSE 'pending' END AS status, a[1] AS pending_at, c[1] AS claimed_at,
  CASE WHEN sent THEN s[1] WHEN c[1] + {STALE} < now THEN c[1] + {STALE} END AS finished_at, n - CAST(sent AS BIGINT) AS refused FROM t""")
def outbox_deliveries(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] or 0
    return outbox(_deliveries(events), ["user_id", "item"], "event_id", "ts", "kind", HIGH_WATER, STALE, now)


@query(f"""WITH RECURSIVE f AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, min((epoch_us(ts), event_id)) AS m FROM events GROUP BY ALL),
  q AS (SELECT user_id, item, m[1] AS queued, row_number() OVER (PARTITION BY user_id ORDER BY m) AS i FROM f),
  s AS (SELECT user_id, item, i, queued, queued AS sent FROM q WHERE i = 1 UNION ALL SELECT q.user_id, q.item, q.i, q.queued, greatest(q.queued, s.sent + 10 * {HOUR}) FROM s JOIN q ON q.user_id = s.user_id AND q.i = s.i + 1)
SELECT user_id, item, queued, sent FROM s""")
def paced_notifications(spark, d):
    """One message each ten hours to a user; slices of five days."""
    e = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return paced(e, "user_id", "item", "at", "event_id", 10 * HOUR, 120 * HOUR)
