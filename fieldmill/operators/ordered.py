"""Operators whose rows depend on what happened before: a step by step scan by key, and the rules that need one.

Each rule is a small function from a state and a row to a new state and results. The batch forms run it over rows that
Spark has partitioned by key and sorted; the stream forms in fieldmill.streaming.processors keep the state between batches.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_scan(rows: DataFrame, keys: list[str], order: list[Column], values: list[str], start: Callable, step: Callable, results: str, end: Callable | None = None) -> DataFrame:
    """keys and the results of step(state, values) -> (state, results) over each key's rows in order; end(state) adds the last results.

    A key's rows pass one task one by one from a sorted, spillable partition: only the state is held. A hot key is one
    task's time, as each row needs the state before it; split it where the rule allows (see `islands`).
    """
    spark, n = rows.sparkSession, len(keys)
    # Spark's own parser reads the schema.
    schema = StructType([rows.schema[k] for k in keys] + list(spark.createDataFrame([], results).schema))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or row[:n] != key:
                    if state is not None and end is not None:
                        out += [key + r for r in end(state)]
                    key, state = row[:n], start()
                state, got = step(state, *row[n:])
                out += [key + r for r in got]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)
        if state is not None and end is not None and (out := [key + r for r in end(state)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.select(*keys, *values).mapInArrow(run, schema)


def islands(rows: DataFrame, keys: list[str], at: str, gap: int, ident: str, name: str = "island") -> DataFrame:
    """rows with the number of their island: rows of a key with no gap of `gap` or more between them. Rules that forget after `gap` can take (key, island) as the key."""
    w = Window.partitionBy(*keys).orderBy(at, ident)
    begins = (F.col(at) - F.lag(at).over(w) >= gap).cast("long")
    return rows.withColumn(name, F.sum(F.coalesce(begins, F.lit(0))).over(w))


# Admission under rolling limits.


@dataclass(frozen=True)
class Limits:
    """rolling: (most, seconds) in the order in which they are looked at; daily: (most, time zone) of a calendar day there, looked at after them."""

    rolling: tuple[tuple[int, int], ...] = ((4, 60), (20, 86_400))
    daily: tuple[tuple[int, str], ...] = ()

    def step(self, state: tuple, ident: int, at: int, *days: int) -> tuple[tuple, list[tuple]]:
        """state: times of the last admissions, as many as the largest limit; for each daily limit the day and its admissions. Times are microseconds."""
        times, counts = state
        refused = next((f"{most} in {seconds} s" for most, seconds in self.rolling if most == 0 or len(times) >= most and at - times[-most] < seconds * 1_000_000), None)
        if refused is None:
            refused = next((f"{most} a day in {zone}" for (most, zone), (day, n), today in zip(self.daily, counts, days) if (n if day == today else 0) >= most), None)
        if refused is None:
            times = (*times, at)[-max((m for m, _ in self.rolling), default=0) :] if self.rolling else ()
            counts = tuple((today, n + 1 if day == today else 1) for (day, n), today in zip(counts, days))
        return (times, counts), [(ident, at, refused is None, refused)]

    def start(self) -> tuple:
        return (), tuple((None, 0) for _ in self.daily)

    def values(self, rows: DataFrame, ident: str, at: str) -> DataFrame:
        """rows with _id, _at and the day of each daily limit, counted from 1970 where its zone's clocks stand."""
        t = F.col(at).cast("timestamp")
        days = [F.unix_date(F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(t, F.current_timezone()), zone))).alias(f"_day{i}") for i, (_, zone) in enumerate(self.daily)]
        return rows.select("*", F.col(ident).alias("_id"), F.unix_micros(t).alias("_at"), *days)


ADMITTED = "id long, at long, admitted boolean, refused_by string"


def admit(rows: DataFrame, keys: list[str], ident: str, at: str, limits: Limits) -> DataFrame:
    """keys, id, at, admitted, refused_by: each attempt in order (time, then identifier) against the admissions before it; refused attempts count for nothing.

    Without a daily limit a gap as long as the longest window empties the state, so a key is split at such gaps.
    """
    t = limits.values(rows, ident, at)
    own, longest = list(keys), max((s for _, s in limits.rolling), default=0)
    if not limits.daily and longest:
        t, own = islands(t, keys, "_at", longest * 1_000_000, "_id", "_island"), [*keys, "_island"]
    days = [f"_day{i}" for i in range(len(limits.daily))]
    return ordered_scan(t, own, [F.col("_at"), F.col("_id")], ["_id", "_at", *days], limits.start, limits.step, ADMITTED).select(*keys, "id", "at", "admitted", "refused_by")


# Jobs with leases and tokens.


@dataclass(frozen=True)
class Leases:
    """A job is queued, running under a lease with a token that rises with each claim, done or failed. Times are microseconds."""

    lease: int = 60_000_000
    back_off: int = 300_000_000
    most: int = 5

    def start(self) -> tuple:
        return None, 0, None, 0, None  # status, token, lease's end, attempts, retry at

    def expire(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        """A lease that is over by `now` gives the job back."""
        status, token, until, attempts, retry = state
        if status != "running" or until > now:
            return state, []
        return ("queued", token, None, attempts, None), [(None, until, "expired", token, attempts)]

    def step(self, state: tuple, ident: int, at: int, kind: str, shown: int | None) -> tuple[tuple, list[tuple]]:
        """kind: enqueue, claim, write or fail; shown is the token that a write or failure shows. A write under another token or after the lease is refused."""
        (status, token, until, attempts, retry), out = self.expire(state, at)
        holds = status == "running" and shown == token
        what = "ignored"
        if kind == "enqueue" and status in (None, "done", "failed"):
            status, attempts, retry, what = "queued", 0, None, "queued"
        elif kind == "claim" and status == "queued" and (retry is None or retry <= at):
            if attempts >= self.most:
                status, what = "failed", "failed"
            else:
                status, token, until, attempts, what = "running", token + 1, at + self.lease, attempts + 1, "claimed"
        elif kind == "write":
            status, until, what = ("done", None, "accepted") if holds else (status, until, "refused")
        elif kind == "fail" and not holds:
            what = "refused"
        elif kind == "fail":
            last = attempts >= self.most
            status, until, retry, what = "failed" if last else "queued", None, None if last else at + self.back_off * attempts, "failed" if last else "retry"
        return (status, token, until, attempts, retry), [*out, (ident, at, what, token, attempts)]


LEASED = "id long, at long, outcome string, token long, attempts long"


def lease_log(rows: DataFrame, key: str, ident: str, at: str, kind: str, shown: str, leases: Leases, now: int | None = None) -> DataFrame:
    """key and, for each row and each lease that ran out: id (null for those), at, outcome, token, attempts. now: leases that are over by then are ended too, although no row follows."""
    t = rows.select(key, F.col(ident).alias("_id"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), F.col(kind).alias("_kind"), F.col(shown).cast("long").alias("_shown"))
    end = None if now is None else lambda state: leases.expire(state, now)[1]
    return ordered_scan(t, [key], [F.col("_at"), F.col("_id")], ["_id", "_at", "_kind", "_shown"], leases.start, leases.step, LEASED, end)


def fenced_merge(old: DataFrame, writes: DataFrame, key: str, token: str) -> tuple[DataFrame, DataFrame]:
    """The table after the writes, and the writes that it refuses: those with an older token than the table, or than another write, has for their key. Both frames have the same columns; keys of old are distinct, one token writes one value."""
    known = old.select(F.col(key).alias("_k"), F.col(token).alias("_t"))
    newest = writes.groupBy(F.col(key).alias("_k")).agg(F.max(token).alias("_t")).unionByName(known).groupBy("_k").agg(F.max("_t").alias("_t"))
    marked = writes.join(newest, F.col(key) == F.col("_k"))
    good = marked.where(F.col(token) == F.col("_t")).drop("_k", "_t").dropDuplicates([key, token])
    return old.join(good.select(key), key, "left_anti").unionByName(good), marked.where(F.col(token) < F.col("_t")).drop("_k", "_t")


# Memory of a crawl.


def remember(memory: OrderedDict, ids: list, most: int) -> tuple[int, int, int]:
    """New, known and forgotten of a sample's distinct ids; the memory keeps the last `most` in the order in which they came in."""
    distinct = list(dict.fromkeys(ids))
    new = [i for i in distinct if i not in memory]
    memory.update(dict.fromkeys(new))
    forgotten = max(0, len(memory) - most)
    for _ in range(forgotten):
        memory.popitem(last=False)
    return len(new), len(distinct) - len(new), forgotten


CRAWLED = "sample long, new long, known long, forgotten long, held long"


def crawl_memory(samples: DataFrame, source: str, sample: str, ids: str, most: int = 3000) -> DataFrame:
    """source, sample, new, known, forgotten, held: each sample (its array of ids, a crawl's page) in order against the last `most` ids of its source. A sample that comes twice counts once."""

    def step(state: list, number: int, found: list | None) -> tuple[list, list[tuple]]:
        memory, last = state
        if last is not None and number <= last:
            return state, []
        got = remember(memory, found or [], most)
        return [memory, number], [(number, *got, len(memory))]

    rows = samples.select(source, F.col(sample).cast("long").alias("_sample"), F.col(ids).alias("_ids"))
    return ordered_scan(rows, [source], [F.col("_sample")], ["_sample", "_ids"], lambda: [OrderedDict(), None], step, CRAWLED)


# Deliveries of an outbox, and their pace: these need no scan.


def outbox(events: DataFrame, keys: list[str], ident: str, at: str, kind: str, high_water: int, stale: int, now: int) -> DataFrame:
    """keys, status, claimed_at, finished_at, refused of each delivery. kind: approve, claim, ack; times are microseconds.

    Approvals up to the high-water mark are history. A later one makes a delivery, once; the first claim behind it takes
    it, the first acknowledgement behind that ends it as sent, if it comes within `stale`; else the delivery is
    uncertain, and is never sent again. refused counts the acknowledgements that ended nothing.
    """
    e = events.select(*keys, F.col(kind).alias("_kind"), F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(ident).alias("id")).alias("_e"))
    first = e.where((F.col("_kind") == "approve") & (F.col("_e.id") > high_water)).groupBy(*keys).agg(F.min("_e").alias("_a"))
    rows = e.join(first, keys)
    claim = rows.where((F.col("_kind") == "claim") & (F.col("_e") > F.col("_a"))).groupBy(*keys).agg(F.min("_e").alias("_c"))
    acks = rows.where(F.col("_kind") == "ack").join(claim, keys, "left").groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.when(F.col("_e") > F.col("_c"), F.col("_e"))).alias("_s"))
    j = first.join(claim, keys, "left").join(acks, keys, "left")
    sent = F.coalesce(F.col("_s.at") - F.col("_c.at") <= stale, F.lit(False))
    lost = F.col("_c").isNotNull() & ~sent & (F.col("_c.at") + stale < now)
    status = F.when(sent, "sent").when(lost, "uncertain").when(F.col("_c").isNotNull(), "sending").otherwise("pending")
    finished = F.when(sent, F.col("_s.at")).when(lost, F.col("_c.at") + stale)
    return j.select(*keys, status.alias("status"), F.col("_a.at").alias("pending_at"), F.col("_c.at").alias("claimed_at"), finished.alias("finished_at"), (F.coalesce("_n", F.lit(0)) - sent.cast("long")).alias("refused"))


def paced(rows: DataFrame, user: str, item: str, at: str, ident: str, interval: int, slice_width: int) -> DataFrame:
    """user, item, queued, sent: the first row of each user and item, sent in order at least `interval` apart, none before it is queued.

    With s_i = max(t_i, s_(i-1) + d), s_i - i d is the largest t_j - j d so far, so running maxima give it. These run
    within slices of time; a slice's count and maximum are carried on, so a user with most of the rows is many tasks.
    """
    t = rows.select(user, item, F.col(at).alias("queued"), F.col(ident).alias("_id"))
    t = t.groupBy(user, item).agg(F.min(F.struct("queued", "_id")).alias("_m")).select(user, item, "_m.queued", "_m._id").withColumn("_slice", F.floor(F.col("queued") / slice_width))
    w = Window.partitionBy(user, "_slice").orderBy("queued", "_id")
    t = t.withColumn("_i", F.row_number().over(w)).withColumn("_m", F.max(F.col("queued") - F.col("_i") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = t.groupBy(user, "_slice").agg(F.count("*").alias("_n"), F.max("_m").alias("_max"))
    before = Window.partitionBy(user).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = sums.withColumn("_carry", F.max(F.col("_max") - F.col("_before") * interval).over(before)).select(user, "_slice", "_before", "_carry")
    j = t.join(sums, [user, "_slice"])
    sent = (F.col("_before") + F.col("_i")) * interval + F.greatest(F.col("_m") - F.col("_before") * interval, F.col("_carry"))
    return j.select(user, item, "queued", sent.alias("sent"))
