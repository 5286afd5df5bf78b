"""Reposts among documents, whole texts and all rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.functions import media, text
from fieldmill.operators import dedupe
from fieldmill.operators.reposts import repost_pairs
from fieldmill.plans.catalogue import query
from fieldmill.sources.readers import table

#: A document's author is its source; its identifiers are the mail addresses in it.
PAIRS = r"""d AS MATERIALIZED (SELECT doc_id AS id, source AS author, sha256(text) AS h, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: 'EMAIL:' || lower(x))) AS ids,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ \n]+', ' ', 'g'), '[a-z0-9._%+-]+@[a-z0-9.-]+', ' ', 'g'), '\+?[0-9][0-9() .-]{6,}[0-9]', ' ', 'g'), '@[a-z0-9_]+', ' ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM documents),
t AS MATERIALIZED (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda w: (length(w) >= 2 OR regexp_matches(w, '[0-9]')) AND w NOT IN ('a', 'an', 'and', 'at', 'for', 'from', 'in', 'is', 'of', 'on', 'or', 'the', 'to', 'with'))) AS tok FROM d),
s AS (SELECT id, 'h:' || h AS signal FROM t WHERE norm <> '' UNION ALL SELECT id, 'p:' || sha256(norm) FROM t WHERE len(tok) >= 3 UNION ALL SELECT id, 'i:' || unnest(ids) FROM t
  UNION ALL SELECT id, 'a:' || author || '#' || (row_number() OVER (PARTITION BY author ORDER BY id) - 1) // 80 FROM t UNION ALL SELECT id, 't:' || w FROM (SELECT id, unnest(tok) AS w FROM t) WHERE NOT regexp_full_match(w, '[0-9]{1,2}')),
k AS (SELECT signal, min(id) AS a FROM s GROUP BY signal HAVING count(*) > 1 AND (signal NOT LIKE 't:%' OR count(*) <= (SELECT least(45, greatest(8, ceil(count(*) * 0.12))) FROM t))),
p AS (SELECT DISTINCT k.a, s.id AS b FROM s JOIN k USING (signal) WHERE s.id <> k.a),
j AS MATERIALIZED (SELECT a, b, inter / (la + lb - inter) AS jac FROM (SELECT p.a, p.b, len(list_intersect(x.tok, y.tok)) AS inter, len(x.tok) AS la, len(y.tok) AS lb FROM p JOIN t x ON x.id = p.a JOIN t y ON y.id = p.b
  WHERE least(len(x.tok), len(y.tok)) >= 0.357 * greatest(len(x.tok), len(y.tok)) OR x.norm = y.norm OR x.h = y.h) WHERE la + lb > 0),
q AS MATERIALIZED (SELECT j.* FROM j JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE jac >= 0.357 OR x.norm = y.norm OR x.h = y.h),
g AS MATERIALIZED (SELECT id, norm, list_distinct(list_transform(range(1, length(norm) - 1), lambda i: substr(norm, i, 3))) AS g FROM t WHERE id IN (SELECT a FROM q UNION SELECT b FROM q)),
v AS (SELECT q.a, q.b, 0.7 * jac + 0.3 * (2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g))) AS s, m.h = n.h AS same, m.norm = n.norm AND length(m.norm) >= 25 AND len(m.tok) >= 3 AS print, m.author = n.author AS author, len(list_intersect(m.ids, n.ids)) AS mails, len(m.tok) AS w
  FROM q JOIN g x ON x.id = q.a JOIN g y ON y.id = q.b JOIN t m ON m.id = q.a JOIN t n ON n.id = q.b),
r AS (SELECT a, b, s, CASE WHEN same AND w >= 2 THEN 'content_hash' WHEN print THEN 'text_fingerprint' WHEN author AND s >= 0.86 AND w >= 5 THEN 'author_text' WHEN mails > 0 AND s >= 0.86 AND w >= 5 THEN 'contact_text' WHEN s >= 0.95 AND w >= 6 THEN 'text_only' END AS method FROM v)"""


def _items(spark, d):
    t = F.col("text")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("url"), F.col("source").alias("author"), F.sha2("text", 256).alias("content_hash"), text.normalise_repost(t).alias("norm"), F.when(F.contains(t, F.lit("@")), F.regexp_extract_all(t, F.lit(media.EMAIL), F.lit(1))).alias("_m"))
    return rows.select("id", "url", "author", "content_hash", "norm", text.tokens(F.col("norm")).alias("tokens"), F.array_distinct(F.transform("_m", lambda x: F.concat(F.lit("EMAIL:"), F.lower(x)))).alias("identifiers"))


@query(f"WITH {PAIRS} SELECT a, b, method, round(s, 6) AS similarity, round(CASE method WHEN 'content_hash' THEN 1.0 WHEN 'text_fingerprint' THEN greatest(0.97, s) WHEN 'text_only' THEN s ELSE least(0.97, 0.7 + 0.3 * s) END, 6) AS confidence FROM r WHERE method IS NOT NULL")
def repost_pairs_of_documents(spark, d):
    out = repost_pairs(_items(spark, d))
    return out.select("a", "b", "method", F.round("similarity", 6).alias("similarity"), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH RECURSIVE {PAIRS}, u AS (SELECT a, b FROM r WHERE method IS NOT NULL UNION SELECT b, a FROM r WHERE method IS NOT NULL),
c AS (SELECT id, id AS reached FROM d UNION SELECT c.id, u.b FROM c JOIN u ON u.a = c.reached) SELECT id, min(reached) AS cluster FROM c GROUP BY id""")
def repost_clusters_of_documents(spark, d):
    items = _items(spark, d)
    return dedupe.clusters(items, repost_pairs(items).select("a", "b"))
