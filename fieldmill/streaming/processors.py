"""The rules of fieldmill.operators.ordered on streams: state by key, timers on event time, restarts from the checkpoint.

They need a state store that holds several variables: `several_states()` sets it. Rows of a key in one batch are put in
order by time and identifier before they are stepped through; that holds the few numbers that a rule takes of each row
of a batch, which the source's trigger bounds. Batches must follow one another in time. Columns are renamed, as a
processor does not get names that begin with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fieldmill.operators.ordered import Leases, Limits


def several_states(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str], by: int) -> list[tuple]:
    """The rows as tuples in the order of their first `by` columns; missing values are None."""
    out = [tuple(None if pd.isna(v) else v for v in r) for pdf in rows for r in zip(*(pdf[c].tolist() for c in columns))]
    return sorted(out, key=lambda r: r[:by])


class _Admission(StatefulProcessor):
    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle) -> None:
        self.state = handle.getValueState("admissions", "times array<long>, days array<int>, counts array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.limits.start()
        if self.state.exists():
            times, days, counts = self.state.get()
            state = tuple(int(t) for t in times), tuple((None if d == -1 << 31 else int(d), int(n)) for d, n in zip(days, counts))
        out = []
        for at, ident, *days in _in_order(rows, ["row_at", "row_id", *(f"row_day{i}" for i in range(len(self.limits.daily)))], 2):
            state, got = self.limits.step(state, int(ident), int(at), *map(int, days))
            out += got
        self.state.update((list(state[0]), [-1 << 31 if d is None else d for d, _ in state[1]], [n for _, n in state[1]]))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", "id", "at", "admitted", "refused_by"])

    def close(self) -> None:
        pass


def admit_stream(rows: DataFrame, key: str, ident: str, at: str, limits: Limits) -> DataFrame:
    """key, id, at, admitted, refused_by, as admit() gives them; the state of a key is its last admissions."""
    t = limits.values(rows.select(key, ident, at), ident, at)
    days = [F.col(f"_day{i}").alias(f"row_day{i}") for i in range(len(limits.daily))]
    t = t.select(F.col(key).cast("long").alias("key"), F.col("_id").alias("row_id"), F.col("_at").alias("row_at"), *days)
    return t.groupBy("key").transformWithStateInPandas(_Admission(limits), "key long, id long, at long, admitted boolean, refused_by string", "Append", "None")


class _Leases(StatefulProcessor):
    def __init__(self, leases: Leases):
        self.leases = leases

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", "status string, token long, until long, attempts long, retry long")

    def _save(self, state: tuple) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.state.update(state)
        if state[0] == "running":
            self.handle.registerTimer(-(-state[2] // 1000))

    def _rows(self, key, out) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in out], columns=["key", "id", "at", "outcome", "token", "attempts"]).astype({"id": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = tuple(self.state.get()) if self.state.exists() else self.leases.start(), []
        for at, ident, kind, shown in _in_order(rows, ["row_at", "row_id", "row_kind", "row_shown"], 2):
            state, got = self.leases.step(state, int(ident), int(at), kind, None if shown is None else int(shown))
            out += got
        self._save(state)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        state, out = self.leases.expire(tuple(self.state.get()), expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if out:
            self.state.update(state)
            yield self._rows(key, out)

    def close(self) -> None:
        pass


def lease_stream(rows: DataFrame, key: str, ident: str, at: str, kind: str, shown: str, leases: Leases, late: str) -> DataFrame:
    """As lease_log(), a lease being ended by a timer once the watermark is past it. at: a timestamp."""
    t = rows.withWatermark(at, late).select(F.col(key).cast("long").alias("key"), F.col(at), F.col(ident).alias("row_id"), F.unix_micros(at).alias("row_at"), F.col(kind).alias("row_kind"), F.col(shown).cast("long").alias("row_shown"))
    return t.groupBy("key").transformWithStateInPandas(_Leases(leases), "key long, id long, at long, outcome string, token long, attempts long", "Append", "EventTime")


class _Outbox(StatefulProcessor):
    def __init__(self, high_water: int, stale: int):
        self.high_water, self.stale = high_water, stale

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("delivery", "status string, claimed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, claimed = self.state.get() if self.state.exists() else (None, None)
        out = []
        for at, ident, kind in _in_order(rows, ["row_at", "row_id", "row_kind"], 2):
            if status == "sending" and at > claimed + self.stale:
                status = "uncertain"
                out.append((status, claimed + self.stale))
            if kind == "approve" and status is None and ident > self.high_water:
                status = "pending"
            elif kind == "claim" and status == "pending":
                status, claimed = "sending", int(at)
                self.handle.registerTimer((claimed + self.stale) // 1000 + 1)
            elif kind == "ack" and status == "sending":
                status = "sent"
            else:
                continue
            out.append((status, int(at)))
        if status is not None:
            self.state.update((status, claimed))
        yield self._rows(key, out)

    def _rows(self, key, out) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in out], columns=["user", "item", "status", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and (held := self.state.get())[0] == "sending":
            self.state.update(("uncertain", held[1]))
            yield self._rows(key, [("uncertain", held[1] + self.stale)])

    def close(self) -> None:
        pass


def outbox_stream(events: DataFrame, user: str, item: str, ident: str, at: str, kind: str, high_water: int, stale: int, late: str) -> DataFrame:
    """user, item, status, at: what each delivery becomes and when, the steps of outbox(); a claim that nobody acknowledges is ended by a timer. Each key is delivered at most once, as its state stays."""
    t = events.withWatermark(at, late).select(F.col(user).cast("long").alias("user"), F.col(item).cast("long").alias("item"), F.col(at), F.unix_micros(at).alias("row_at"), F.col(ident).alias("row_id"), F.col(kind).alias("row_kind"))
    return t.groupBy("user", "item").transformWithStateInPandas(_Outbox(high_water, stale), "user long, item long, status string, at long", "Append", "EventTime")


class _Crawl(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.place = handle.getMapState("place", "id long", "at long")  # of each id that is held
        self.held = handle.getMapState("held", "at long", "id long")
        self.ends = handle.getValueState("ends", "first long, next long, sample long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, end, last = self.ends.get() if self.ends.exists() else (0, 0, None)
        out = []
        for sample, ids in sorted((int(s), list(i)) for pdf in rows for s, i in zip(pdf["row_sample"], pdf["row_ids"])):
            if last is not None and sample <= last:
                continue
            new = known = forgotten = 0
            fresh = []
            for i in dict.fromkeys(int(i) for i in ids):
                known, new = (known + 1, new) if self.place.containsKey((i,)) else (known, new + 1)
                if not self.place.containsKey((i,)):
                    fresh.append(i)
            for i in fresh:
                self.place.updateValue((i,), (end,))
                self.held.updateValue((end,), (i,))
                end += 1
            while end - first > self.most:
                self.place.removeKey(self.held.getValue((first,)))
                self.held.removeKey((first,))
                first, forgotten = first + 1, forgotten + 1
            last = sample
            out.append((key[0], sample, new, known, forgotten, end - first))
        self.ends.update((first, end, last))
        yield pd.DataFrame(out, columns=["source", "sample", "new", "known", "forgotten", "held"])

    def close(self) -> None:
        pass


def crawl_stream(samples: DataFrame, source: str, sample: str, ids: str, most: int = 3000) -> DataFrame:
    """As crawl_memory(); the memory is two maps, by id and by place, so that a sample reads and writes its own ids and those it pushes out."""
    t = samples.select(F.col(source).cast("string").alias("source"), F.col(sample).cast("long").alias("row_sample"), F.col(ids).cast("array<long>").alias("row_ids"))
    return t.groupBy("source").transformWithStateInPandas(_Crawl(most), "source string, sample long, new long, known long, forgotten long, held long", "Append", "None")
