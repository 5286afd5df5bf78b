"""The stateful operators on streams; each has a batch form in fieldmill.operators.analytics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.operators.analytics import BACK_OFF, CONFIRM_HOURS


def activity(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts by tumbling or sliding window; on a stream `late` bounds the state."""
    if late:
        events = events.withWatermark(time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once: an outbox that notifies a pair of user and item at most once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


STATE = "status string, first_removed long, unknowns int"
OUT = "id long, status string, next_check long"


def step(status: str, first: int | None, unknowns: int, kind: str, at: int) -> tuple[str, int | None, int, int | None]:
    """One observation; the same rule as transition() of the batch form. A confirmed removal stays."""
    if status == "REMOVED":
        return status, first, unknowns, None
    if kind == "ALIVE":
        return "ALIVE", None, 0, at + 86400
    if kind == "REMOVED":
        done = first is not None and at - first >= CONFIRM_HOURS * 3600
        return "REMOVED" if done else "SUSPECTED", at if first is None else first, 0, at + CONFIRM_HOURS * 3600
    unknowns += 1
    return status, first, unknowns, at + BACK_OFF[min(unknowns, len(BACK_OFF)) - 1] * 3600


def track(observations: DataFrame) -> DataFrame:
    """id, status, next_check after each batch of observations (id, kind, at) of a stream."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, first, unknowns = state.get if state.exists else ("NEW", None, 0)
        nxt = None
        for r in pd.concat(list(batches)).sort_values("at").itertuples():
            status, first, unknowns, nxt = step(status, first, unknowns, r.kind, int(r.at))
        state.update((status, first, unknowns))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "next_check": [nxt]}).astype({"next_check": "Int64"})

    return observations.groupBy("id").applyInPandasWithState(run, OUT, STATE, "update", "NoTimeout")
