"""State of sources and listings over time: coverage, rates, availability, jobs, changes, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.operators.shaping import first_per_group


def round_robin(sources: DataFrame, index: str, cursor: int, size: int, total: int) -> DataFrame:
    """The next `size` of `total` sources from a cursor on, around the end."""
    return sources.where(F.pmod(F.col(index) - cursor, F.lit(total)) < min(size, total))


def unseen(posts: DataFrame, memory: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n posts that the memory of identifiers does not hold."""
    return posts.join(memory.select(key).distinct(), key, "left_anti").orderBy(*order).limit(n)


def adaptive_interval(current_s: Column, new_posts: Column) -> Column:
    """Seconds to the next visit: five minutes after something new, else twice as long as before, up to four hours."""
    return F.when(new_posts > 0, 300).otherwise(F.least(current_s * 2, F.lit(4 * 3600)))


def interval_fold(visits: DataFrame, key: str, at: str, new_posts: str, start_s: int = 300) -> DataFrame:
    """key, interval after each source's visits in order. Only the visits after the last one with something new matter, so they are counted, not gathered."""
    last = visits.groupBy(key).agg(F.max(F.when(F.col(new_posts) > 0, F.col(at))).alias("_last"))
    idle = visits.join(last, key).where(F.col("_last").isNull() | (F.col(at) > F.col("_last"))).groupBy(key).agg(F.count("*").alias("_n"))
    seconds = F.least(F.lit(4.0 * 3600), F.lit(float(start_s)) * F.pow(F.lit(2.0), F.coalesce("_n", F.lit(0)))).cast("long")
    return last.join(idle, key, "left").select(key, seconds.alias("interval"))


def availability_fold(signals: DataFrame, listing: str, source: str, signal: str, at: str, days: int = 30) -> DataFrame:
    """listing, status, confirmed_at from the last signal (available, unavailable) of each source within `days` of the listing's last one; one available source outweighs others."""
    rows = first_per_group(signals.where(F.col(signal).isin("available", "unavailable")), [listing, source], [F.desc(at), F.asc(signal)])
    newest = rows.groupBy(listing).agg(F.max(at).alias("_now"))
    recent = rows.join(newest, listing).where(F.col(at) >= F.col("_now") - F.make_interval(days=F.lit(days)))
    free = F.col(signal) == "available"
    out = recent.groupBy(listing).agg(F.bool_or(free).alias("_free"), F.max(F.when(free, F.col(at))).alias("_a"), F.max(F.when(~free, F.col(at))).alias("_u"))
    return out.select(listing, F.when(F.col("_free"), "available").otherwise("rented").alias("status"), F.when(F.col("_free"), F.col("_a")).otherwise(F.col("_u")).alias("confirmed_at"))


def claimable(jobs: DataFrame, now: Column, retry_s: int = 300, most_attempts: int = 5) -> DataFrame:
    """Jobs that a worker may take at `now`: queued and due after their back-off, or running with a lease that is over. columns: status, lease_until, attempts, updated_at."""
    wait = F.col("updated_at") + F.col("attempts") * retry_s
    due = (F.col("status") == "queued") & ((F.col("attempts") == 0) | (wait <= now))
    lost = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.where((due | lost) & (F.col("attempts") < most_attempts)).withColumn("token", F.col("attempts") + 1)


def group_activity(samples: DataFrame, group: str, sample: str, post: str, at: str, limit: int) -> DataFrame:
    """A row for each sample of a group: posts, new ones, inversions, whether the limit was reached, coverage against the sample before, measured posts an hour.

    samples: a row for each post of a sample with its position; samples are numbered in order. at is in seconds.
    """
    rows = samples.groupBy(group, sample, post).agg(F.min("position").alias("position"), F.max(at).alias("_t"))
    first = rows.groupBy(group, post).agg(F.min(sample).alias("_first"))
    rows = rows.join(first, [group, post])
    w = Window.partitionBy(group, sample).orderBy("position")
    rows = rows.withColumn("_inv", (F.col("_t") > F.lag("_t").over(w)).cast("int"))
    before = rows.select(F.col(group).alias("_g"), F.col(post).alias("_p"), (F.col(sample) + 1).alias("_s"))
    rows = rows.join(before, (F.col(group) == F.col("_g")) & (F.col(post) == F.col("_p")) & (F.col(sample) == F.col("_s")), "left")
    one = rows.groupBy(group, sample).agg(
        F.count("*").alias("posts"), F.count_if(F.col("_first") == F.col(sample)).alias("fresh"), F.coalesce(F.sum("_inv"), F.lit(0)).alias("inversions"),
        F.count("_p").alias("_shared"), F.min("_t").alias("_old"), F.max("_t").alias("_new"), F.count("_t").alias("_dated"),
    )
    v = Window.partitionBy(group).orderBy(sample)
    seen = F.max("_new").over(v.rowsBetween(Window.unboundedPreceding, -1))
    cover = F.when(F.row_number().over(v) == 1, "initial").when((F.col("inversions") > 0) | F.col("_new").isNull() | seen.isNull(), "unknown").when(F.col("_shared") > 0, "overlap").when(F.col("_old") <= seen, "timestamp_reach_unverified").otherwise("possible_gap")
    hours = (F.col("_new") - F.col("_old")) / 3600
    rate = F.when((F.col("_dated") >= 3) & (hours > 0), F.round((F.col("_dated") - 1) / hours, 4))
    return one.withColumn("coverage", cover).select(group, sample, "posts", "fresh", "inversions", (F.col("posts") >= limit).alias("capped"), "coverage", rate.alias("per_hour"))


def decayed_rate(samples: DataFrame, group: str, sample: str, rate: str, keep: float = 0.8) -> DataFrame:
    """group, rate: max(new, keep x old) over a group's samples. That fold is the largest rate times keep to the number of measured samples after it, so it is an aggregate."""
    w = Window.partitionBy(group).orderBy(F.desc(sample))
    rows = samples.where(F.col(rate).isNotNull()).withColumn("_age", F.row_number().over(w) - 1)
    return rows.groupBy(group).agg(F.round(F.max(F.col(rate) * F.pow(F.lit(keep), F.col("_age"))), 4).alias("rate"))


def status_events(before: DataFrame, after: DataFrame, key: str, status: str, wanted: str) -> DataFrame:
    """Keys whose status became `wanted` between two snapshots; a key that is new with it counts."""
    b = before.select(F.col(key).alias("_k"), F.col(status).alias("_was"))
    j = after.where(F.col(status) == wanted).join(b, F.col(key) == F.col("_k"), "left")
    return j.where(~F.col("_was").eqNullSafe(F.lit(wanted))).select(key, F.col("_was").alias("was"))


def to_enrich(items: DataFrame, state: DataFrame, key: str, content: str) -> DataFrame:
    """Items that are new, changed or without a class. state: key, content, class."""
    s = state.select(F.col(key).alias("_k"), F.col(content).alias("_c"), F.col("class").alias("_class"))
    return items.join(s, F.col(key) == F.col("_k"), "left").where(F.col("_k").isNull() | ~F.col("_c").eqNullSafe(F.col(content)) | F.col("_class").isNull()).drop("_k", "_c", "_class")


def enriched(items: DataFrame, state: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Items with the class of the results, else that of before."""
    r = results.select(F.col(key).alias("_r"), F.col("class").alias("_new"))
    s = state.select(F.col(key).alias("_s"), F.col("class").alias("_old"))
    return items.join(r, F.col(key) == F.col("_r"), "left").join(s, F.col(key) == F.col("_s"), "left").withColumn("class", F.coalesce("_new", "_old")).drop("_r", "_new", "_s", "_old")


def sweep(listings: DataFrame, observations: DataFrame, key: str) -> DataFrame:
    """outcome, n of a check of listings (key, price, hash) by observations (key, state alive or dead, price, hash): only an explicit tombstone is a removal."""
    o = observations.select(F.col(key).alias("_k"), "state", F.col("price").alias("_price"), F.col("hash").alias("_hash"))
    j = listings.join(o, F.col(key) == F.col("_k"), "left")
    outcome = F.when(F.col("state") == "dead", "removed").when((F.col("state") == "alive") & ~F.col("hash").eqNullSafe(F.col("_hash")), "changed").when((F.col("state") == "alive") & ~F.col("price").eqNullSafe(F.col("_price")), "price_synced").when(F.col("state") == "alive", "confirmed").otherwise("unknown")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def attribution(links: DataFrame, events: DataFrame, slug: str, kind: str) -> DataFrame:
    """slug, clicks, opens of each link; links without events have none."""
    n = events.groupBy(F.col(slug).alias("_s")).agg(F.count_if(F.col(kind) == "click").alias("_c"), F.count_if(F.col(kind) == "open").alias("_o"))
    return links.join(n, F.col(slug) == F.col("_s"), "left").select(slug, F.coalesce("_c", F.lit(0)).alias("clicks"), F.coalesce("_o", F.lit(0)).alias("opens"))


def before_after(before: DataFrame, after: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """metric, before, after, change of scalar metrics (as double) over two snapshots."""

    def long(df: DataFrame, name: str) -> DataFrame:
        one = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias(name)) for k in metrics])).alias("x")).select("x.*")

    return long(before, "before").join(long(after, "after"), "metric").withColumn("change", F.col("after") - F.col("before"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, filled: how many rows have a value; an empty text is none."""
    one = rows.agg(*[F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x")).select("x.*")


def source_report(posts: DataFrame, source: str, kind: str, kinds: list[str], item: str, ident: str) -> DataFrame:
    """A row for each source: posts, posts of each kind and per 100, items first seen there, and the rate of others in per cent."""
    first = posts.groupBy(item).agg(F.min(ident).alias("_first"))
    j = posts.join(first, item)
    own = F.count_if(F.col(ident) == F.col("_first"))
    per = [x for k in kinds for x in (F.count_if(F.col(kind) == k).alias(k), F.round(100.0 * F.count_if(F.col(kind) == k) / F.count("*"), 2).alias(f"{k}_per_100"))]
    return j.groupBy(source).agg(F.count("*").alias("posts"), *per, own.alias("credited"), F.round(100.0 * (F.count("*") - own) / F.count("*"), 2).alias("duplicate_rate"))


def cascade(roots: DataFrame, key: str, tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """table, id of all rows that a delete of the roots takes along. tables: name, rows, own key, parent's key, parents before their children; each hangs on the one before."""
    gone, out = roots.select(F.col(key).alias("id")).distinct(), []
    for name, rows, own, parent in tables:
        gone = rows.join(gone, F.col(parent) == gone["id"], "left_semi").select(F.col(own).alias("id")).distinct()
        out.append(gone.select(F.lit(name).alias("table"), "id"))
    return reduce(DataFrame.unionByName, out)


def batch_contract(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """problem, n of a batch's answers (id) against what was asked (id): empty, duplicate, unknown, missing. No rows if the contract holds."""
    given = answered.groupBy("id").agg(F.count("*").alias("_n"))
    asked = expected.select(F.col("id").alias("_e")).distinct()
    j = given.join(asked, F.col("id") == F.col("_e"), "full_outer")
    blank = F.col("_e").isNull() & (F.col("id").isNull() | (F.trim("id") == ""))
    problem = F.when(blank, "empty").when(F.col("_e").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
    return j.withColumn("problem", problem).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


def hashed_sample(rows: DataFrame, ident: str, seed: str, n: int) -> DataFrame:
    """The n rows of the least hashes of seed and identifier: the same ones in every run."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(ident).cast("string")), 256)).limit(n)


def map_view(listings: DataFrame, inside: Column, located: Column, area: Column, most: int = 300) -> DataFrame:
    """exact, key, n, low, high: markers within the view, at most `most` by identifier, and all areas of listings without a place, under negative numbers."""
    exact = listings.where(located & inside).orderBy("id").limit(most).select(F.lit(True).alias("exact"), F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"), F.col("price").alias("low"), F.col("price").alias("high"))
    rest = listings.where(~located).groupBy(area.alias("key")).agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    return exact.unionByName(rest.select(F.lit(False).alias("exact"), F.col("key").cast("string"), "n", "low", "high"))
