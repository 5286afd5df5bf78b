import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import ordered as O
from fieldmill.plans import streams as S
from fieldmill.streaming import processors as P
from fieldmill.streaming.ingest import ItemTable

FOLDER = "/root/testdata/sf0.001"


def parts(frame, order, folder, n, begin=0):
    """Writes a frame as n files in order of time, one after the other."""
    edges = frame.approxQuantile(order, [i / n for i in range(1, n)], 0.0) if n > 1 else []
    for i in range(begin, n):
        low, high = edges[i - 1] if i else None, edges[i] if i < n - 1 else None
        part = frame.where((F.lit(True) if low is None else F.col(order) > low) & (F.lit(True) if high is None else F.col(order) <= high))
        part.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
        yield i


def ran(stream, folder, mode="append"):
    """Appends what a stream gives to a table, with a checkpoint beside it, until what is there is done."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def restarted(spark, frame, order, folder, build, n=4):
    """The rows of a stream over n files that stops after half of them and starts again from its checkpoint."""
    P.several_states(spark)
    files = parts(frame, order, folder / "in", n)
    for _ in range(n // 2):
        next(files)
    source = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    ran(build(source()), folder)
    half = spark.read.parquet(f"{folder}/out").count()
    for _ in files:
        pass
    ran(build(source()), folder)
    out = spark.read.parquet(f"{folder}/out")
    assert 0 < half < out.count()
    return out


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


# Ingest.


def test_stream_of_batches_equals_one_batch_and_replays_change_nothing(spark, tmp_path):
    posts = S._posts(spark, FOLDER)
    items = ItemTable(spark, f"file://{tmp_path}/table", payload=["payload"], buckets=8)
    files = parts(posts, "seq", tmp_path / "in", 4)
    next(files), next(files)
    stream = lambda: spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    items.follow(stream(), f"{tmp_path}/check").awaitTermination()
    assert rows(items.log().select("batch").distinct(), "batch") == [(0,), (1,)]
    for _ in files:
        pass
    items.follow(stream(), f"{tmp_path}/check").awaitTermination()
    after = rows(items.items(posts), *items.items(posts).columns)
    assert items.merge(posts.limit(5), 3) is False and rows(items.items(posts), *items.items(posts).columns) == after
    whole = ItemTable(spark, f"file://{tmp_path}/whole", payload=["payload"], buckets=8)
    assert whole.merge(posts, 0) is True
    assert rows(whole.items(posts), *whole.items(posts).columns) == after
    status = ["source", "external_id", "seq", "status", "version"]
    assert rows(whole.outcomes(), *status) == rows(items.outcomes(), *status)
    assert items.versions().count() == sum(r[-1] for r in after)


POST = "source string, external_id string, content_hash string, media_hash string, observed_at timestamp, seq long, text string"


def post(ident, content, media, at, seq, text="t", source="s"):
    return (source, ident, content, media, datetime(2024, 1, at, tzinfo=timezone.utc), seq, text)


def test_statuses_late_rows_errors_and_only_touched_buckets(spark, tmp_path):
    t = ItemTable(spark, f"file://{tmp_path}/t", payload=["text"], buckets=16)
    frame = lambda *r: spark.createDataFrame(r, POST)
    first = frame(post("a", "1", None, 5, 1, "old"), post("b", "1", "m", 5, 2), post("b", "2", "m", 6, 3, "b2"), post(None, "1", None, 5, 4), ("s", "x", "1", None, None, 5, "t"))
    look = rows(t.preview(first), "external_id", "status", "version")
    assert not (tmp_path / "t").exists()
    assert t.merge(first, 0)
    assert rows(t.outcomes(), "external_id", "status", "version") == look == sorted([("a", "new", 1), ("b", "new", 1), ("b", "updated", 2), (None, "error", None), ("x", "error", None)], key=str)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t/items").rglob("*.parquet")}
    before = files()
    # Late and unchanged: the text stays, last_seen does not fall; then pictures change.
    assert t.merge(frame(post("a", "1", None, 2, 9, "other")), 1)
    assert {f: m for f, m in files().items() if f in before} == before and len(files()) == len(before) + 1
    a = lambda: t.items(first).where("external_id = 'a'").select("text", "version", F.dayofmonth("first_seen"), F.dayofmonth("last_seen")).first()
    assert tuple(a()) == ("old", 1, 2, 5)
    assert t.merge(frame(post("a", "1", "p", 8, 10, "new")), 2) and tuple(a()) == ("new", 2, 2, 8)
    assert t.merge(frame(), 3) and t.merge(frame(post("a", "9", "p", 9, 11)), 3) is False
    other = ItemTable(spark, t.root, payload=["text"], buckets=16, writer="second")
    assert other.merge(frame(post("c", "1", None, 9, 1)), 0) and t.items(first).count() == 3


def test_a_commit_that_was_cut_off_is_not_seen_and_overwritten(spark, tmp_path):
    t = ItemTable(spark, f"file://{tmp_path}/t", payload=["text"], buckets=4)
    frame = lambda *r: spark.createDataFrame(r, POST)
    t.merge(frame(post("a", "1", None, 1, 1)), 0)
    log = t.log().collect()
    t.merge(frame(post("a", "2", None, 2, 2), post("z", "1", None, 2, 3)), 1)
    spark.createDataFrame(log, t.log().schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/log0")
    (tmp_path / "t/log").rename(tmp_path / "gone")
    (tmp_path / "log0").rename(tmp_path / "t/log")
    assert rows(t.items(frame()), "external_id", "content_hash") == [("a", "1")]
    t.merge(frame(post("b", "7", None, 3, 4)), 1)
    assert rows(t.items(frame()), "external_id", "content_hash") == [("a", "1"), ("b", "7")] and t.outcomes().count() == 2


# Limits.


def slow_admit(attempts, rolling):
    """The rule over lists of all admissions."""
    out, passed = [], {}
    for user, at, ident in sorted(attempts):
        mine = passed.setdefault(user, [])
        refused = next((f"{m} in {s} s" for m, s in rolling if sum(at - t < s * 1_000_000 for t in mine) >= m), None)
        if refused is None:
            mine.append(at)
        out.append((user, ident, at, refused is None, refused))
    return sorted(out, key=str)


def test_admissions_of_a_hot_key_ties_and_islands(spark):
    rng = random.Random(5)
    attempts = [(0 if rng.random() < 0.6 else rng.randrange(5), (rng.randrange(2000) * 3000 + rng.randrange(12) * 5) * 1_000_000, i) for i in range(2500)] + [(3, 10**13 + i * 5_000_000, 9000 + i) for i in range(9)]
    df = spark.createDataFrame([(u, datetime.fromtimestamp(t / 1e6, timezone.utc), i, "x") for u, t, i in attempts], "user long, ts timestamp, n long, island string").repartition(5)
    for rolling in (((4, 60), (20, 86_400)), ((1, 5),), ((0, 60),)):
        got = rows(O.admit(df, ["user"], "n", "ts", O.Limits(rolling)), "user", "id", "at", "admitted", "refused_by")
        assert got == slow_admit(attempts, rolling)
    assert {r[4] for r in slow_admit(attempts, ((4, 60), (20, 86_400)))} == {None, "4 in 60 s", "20 in 86400 s"}
    assert O.admit(df.limit(0), ["user"], "n", "ts", O.Limits()).count() == 0


def test_a_calendar_day_follows_the_clocks(spark):
    # Clocks went forward on 2024-03-10 and back on 2024-11-03: days of 23 and 25 hours.
    at = lambda *t: datetime(2024, *t, tzinfo=timezone.utc)
    times = [at(3, 10, 8, 30), at(3, 11, 6, 30), at(3, 11, 7, 30), at(11, 3, 7, 30), at(11, 4, 7, 30), at(11, 4, 8, 30)]
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)], "user long, ts timestamp, n long")
    got = rows(O.admit(df, ["user"], "n", "ts", O.Limits((), ((1, "America/Los_Angeles"),))), "id", "admitted")
    assert got == [(0, True), (1, False), (2, True), (3, True), (4, False), (5, True)]


def test_admissions_on_a_stream_with_a_restart(spark, events, tmp_path):
    for name, limits in (("rolling", S.ROLLING), ("daily", S.CALENDAR)):
        want = O.admit(events, ["user_id"], "event_id", "ts", limits)
        got = restarted(spark, events, "event_id", tmp_path / name, lambda s, limits=limits: P.admit_stream(s, "user_id", "event_id", "ts", limits))
        assert rows(got, "key", "id", "at", "admitted", "refused_by") == rows(want, "user_id", "id", "at", "admitted", "refused_by")
        assert {r["admitted"] for r in want.collect()} == {True, False}


# Leases.


def test_leases_tokens_and_the_late_writer(spark):
    minute = 60_000_000
    jobs = [(1, 0, "enqueue", None), (2, 1, "claim", None), (3, 2, "claim", None), (4, 7, "claim", None), (5, 8, "write", 1), (6, 9, "write", 2), (7, 9, "write", 2),
            (8, 10, "enqueue", None), (9, 11, "claim", None), (10, 12, "fail", 3), (11, 13, "claim", None), (12, 30, "claim", None), (13, 31, "fail", 4), (14, 50, "claim", None), (15, 57, "claim", None)]
    df = spark.createDataFrame([(7, i, datetime.fromtimestamp(m * 60, timezone.utc), k, t) for i, m, k, t in jobs], "job long, n long, ts timestamp, kind string, token long")
    log = O.lease_log(df, "job", "n", "ts", "kind", "token", O.Leases(lease=5 * minute, back_off=5 * minute, most=3))
    got = [(r["id"], r["outcome"], r["token"], r["attempts"]) for r in sorted(log.collect(), key=lambda r: (r["at"], r["id"] or 0))]
    assert got == [(1, "queued", 0, 0), (2, "claimed", 1, 1), (3, "ignored", 1, 1), (None, "expired", 1, 1), (4, "claimed", 2, 2), (5, "refused", 2, 2), (6, "accepted", 2, 2), (7, "refused", 2, 2),
                   (8, "queued", 2, 0), (9, "claimed", 3, 1), (10, "retry", 3, 1), (11, "ignored", 3, 1), (12, "claimed", 4, 2), (13, "retry", 4, 2), (14, "claimed", 5, 3), (None, "expired", 5, 3), (15, "failed", 5, 3)]
    ends = O.lease_log(df.where("n <= 2"), "job", "n", "ts", "kind", "token", O.Leases(lease=5 * minute), now=6 * minute)
    assert [r["at"] // minute for r in ends.where("outcome = 'expired'").collect()] == [6]


def test_fenced_merge_refuses_older_tokens(spark):
    schema = "job long, token long, value string"
    old = spark.createDataFrame([(1, 5, "kept"), (2, 1, "old"), (3, 2, "none")], schema)
    new = spark.createDataFrame([(1, 4, "late"), (2, 2, "two"), (2, 3, "three"), (2, 3, "three"), (4, 1, "first")], schema)
    table, refused = O.fenced_merge(old, new, "job", "token")
    assert rows(table, "job", "token", "value") == [(1, 5, "kept"), (2, 3, "three"), (3, 2, "none"), (4, 1, "first")]
    assert rows(refused, "job", "token", "value") == [(1, 4, "late"), (2, 2, "two")]


def test_leases_on_a_stream_end_by_timers(spark, tmp_path):
    jobs = S._jobs(spark, FOLDER).withColumn("ts", F.col("ts").cast("timestamp"))
    got = restarted(spark, jobs, "event_id", tmp_path, lambda s: P.lease_stream(s, "user_id", "event_id", "ts", "kind", "shown", S.LEASES, "0 seconds"))
    want = O.lease_log(jobs, "user_id", "event_id", "ts", "kind", "shown", S.LEASES)
    columns = ["id", "at", "outcome", "token", "attempts"]
    got, want = set(rows(got, "key", *columns)), set(rows(want, "user_id", *columns))
    # Beside the leases that a later row shows to be over, timers end those that nothing follows.
    assert want <= got and {r[3] for r in got - want} <= {"expired"} and {"claimed", "accepted", "refused", "expired", "queued", "ignored"} <= {r[3] for r in want}


# Outbox, pace and memory.


def test_outbox_on_a_stream_with_a_restart(spark, events, tmp_path):
    e = S._deliveries(events).where("event_id > 20")
    now = events.agg(F.max(F.unix_micros("ts"))).first()[0]
    want = set()
    for r in O.outbox(e, ["user_id", "item"], "event_id", "ts", "kind", 100, S.STALE // 6, now).collect():
        want.add((r["user_id"], r["item"], "pending", r["pending_at"]))
        if r["claimed_at"] is not None:
            want.add((r["user_id"], r["item"], "sending", r["claimed_at"]))
        if r["finished_at"] is not None:
            want.add((r["user_id"], r["item"], r["status"], r["finished_at"]))
    got = restarted(spark, e, "event_id", tmp_path, lambda s: P.outbox_stream(s, "user_id", "item", "event_id", "ts", "kind", 100, S.STALE // 6, "0 seconds"))
    got = [tuple(r) for r in got.select("user", "item", "status", "at").collect()]
    assert len(got) == len(set(got)) and {w[2] for w in want} == {"pending", "sending", "sent", "uncertain"}
    # The last claims are still open for the stream, whose watermark ends with its last batch.
    assert set(got) <= want and all(w[2] == "uncertain" for w in want - set(got)) and len(want - set(got)) < 5


def test_outbox_by_hand(spark):
    rows_in = [(1, 1, 0, 1, "approve"), (1, 1, 1, 2, "ack"), (1, 1, 2, 3, "claim"), (1, 1, 3, 4, "approve"), (1, 1, 12, 5, "ack"), (1, 1, 13, 6, "ack"), (2, 1, 0, 0, "approve"), (3, 1, 5, 7, "approve"), (3, 1, 6, 8, "claim"), (4, 1, 1, 9, "claim"), (4, 1, 1, 10, "approve"), (5, 1, 1, 11, "approve"), (5, 1, 2, 12, "claim"), (5, 1, 13, 13, "ack")]
    df = spark.createDataFrame([(u, i, n, k, datetime.fromtimestamp(s, timezone.utc)) for u, i, s, n, k in rows_in], "user long, item long, n long, kind string, ts timestamp")
    out = O.outbox(df, ["user", "item"], "n", "ts", "kind", 0, 10_000_000, 15_000_000)
    assert rows(out, "user", "status", "finished_at", "refused") == [(1, "sent", 12_000_000, 2), (3, "sending", None, 0), (4, "pending", None, 0), (5, "uncertain", 12_000_000, 1)]


def test_pace_equals_a_loop_for_any_slice(spark):
    rng = random.Random(2)
    sends = [(rng.choice([1, 1, 1, 2]), rng.randrange(300), rng.randrange(4000), i) for i in range(600)]
    df = spark.createDataFrame(sends, "user long, item long, t long, n long").repartition(4)
    want, queued, last = [], {}, {}
    for u, i, t, n in sorted(sends, key=lambda s: (s[2], s[3])):
        queued.setdefault((u, i), (t, n))
    for (u, i), (t, n) in sorted(queued.items(), key=lambda x: x[1]):
        last[u] = max(t, last[u] + 7) if u in last else t
        want.append((u, i, t, last[u]))
    for width in (10, 500, 100_000):
        assert rows(O.paced(df, "user", "item", "t", "n", 7, width), "user", "item", "queued", "sent") == sorted(want, key=str)


def test_memory_forgets_in_order_and_ignores_a_sample_that_comes_again(spark, tmp_path, events):
    samples = [("g", 1, [1, 2, 2, 3]), ("g", 2, [3, 4]), ("g", 2, [9]), ("g", 3, [1, 5]), ("g", 4, []), ("h", 1, None)]
    df = spark.createDataFrame(samples, "source string, sample long, ids array<long>")
    first = df.where("ids IS NULL OR NOT array_contains(ids, 9)")
    want = [("g", 1, 3, 0, 0, 3), ("g", 2, 1, 1, 1, 3), ("g", 3, 2, 0, 2, 3), ("g", 4, 0, 0, 0, 3), ("h", 1, 0, 0, 0, 0)]
    assert rows(O.crawl_memory(first, "source", "sample", "ids", 3), "source", "sample", "new", "known", "forgotten", "held") == want
    days = S._samples(events)
    columns = ["sample", "new", "known", "forgotten", "held"]
    want = rows(O.crawl_memory(days, "event_type", "sample", "ids", 7), "event_type", *columns)
    got = restarted(spark, days, "sample", tmp_path, lambda s: P.crawl_stream(s, "event_type", "sample", "ids", 7))
    assert rows(got, "source", *columns) == want and max(w[4] for w in want) > 0
