"""Funnel, planning, freshness and moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.operators.shaping import asof_join


def actor(chat: Column, user: Column, event: Column) -> Column:
    return F.coalesce(F.concat(F.lit("tg:"), chat.cast("string")), F.concat(F.lit("user:"), user.cast("string")), F.concat(F.lit("event:"), event.cast("string")))


def funnel_stages(events: DataFrame, stages: list[str], actor_col: str, item_col: str, kind_col: str) -> DataFrame:
    """stage, users, items, events for each stage. One pass: a group for each stage, counts pre-aggregated."""
    rows = events.where(F.col(kind_col).isin(*stages))
    return rows.groupBy(F.col(kind_col).alias("stage")).agg(F.countDistinct(actor_col).alias("users"), F.countDistinct(item_col).alias("items"), F.count("*").alias("events"))


def funnel_rates(stages: DataFrame, order: list[str]) -> DataFrame:
    """Each later stage's users as a share of the stage's before, rounded to 4 places; null if that one is empty."""
    one = stages.agg(*[F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("users"))), F.lit(0)).alias(s) for s in order])
    pairs = [F.struct(F.lit(b).alias("stage"), F.when(F.col(a) > 0, F.round(F.col(b) / F.col(a), 4)).alias("rate")) for a, b in zip(order, order[1:])]
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def time_to_convert(events: DataFrame, keys: list[str], time: str, kind: str, first: str, second: str, tie: str) -> DataFrame:
    """conversions, median_seconds between the last `first` event before a `second` one of the same keys and it."""
    rows = events.where(F.col(kind).isin(first, second))
    j = asof_join(rows, keys, time, F.col(kind) == first, F.col(time), "_seen", tie).where("_seen IS NOT NULL")
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_seen").cast("timestamp"))
    return j.agg(F.count("*").alias("conversions"), F.round(F.median(gap / 1e6), 1).alias("median_seconds"))


def search_context(json: Column) -> Column:
    """direct, broad, filtered or invalid: whether a search context is absent, without filters, with some, or not an object."""
    parsed = F.from_json(json, "map<string,string>")
    used = F.size(F.map_filter(parsed, lambda k, v: v.isNotNull() & (v != "") & (v != "[]")))
    return F.when(json.isNull() | (json == ""), "direct").when(~F.startswith(F.trim(json), F.lit("{")) | parsed.isNull(), "invalid").when(used > 0, "filtered").otherwise("broad")


def due_after(age_days: Column) -> Column:
    """Hours between checks: 12 in the first 7 days, 72 to 30 days, then 168."""
    return F.when(age_days <= 7, 12).when(age_days <= 30, 72).otherwise(168)


def skip_reason(stale: Column, wanted: Column, bound: Column, open_job: Column, due: Column) -> Column:
    """The first reason for which a listing is not planned; null if it is."""
    return F.when(~stale, "fresh").when(~wanted, "no_demand").when(~bound, "unbound").when(open_job, "open_job").when(~due, "not_due")


def priority(age_days: Column, demand: Column, weight: int = 5) -> Column:
    return F.least(F.lit(100), 70 + age_days + weight * demand)


def hold_codes(rules: list[tuple[str, Column]]) -> Column:
    """The codes of the rules that hold; a record without codes is approved."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules]))


#: Hours between two removals that confirm each other; back-off after 1, 2, 3 and more unknown observations.
CONFIRM_HOURS, BACK_OFF = 6, (1, 6, 24)


def transition(state: Column, kind: Column, at: Column) -> Column:
    """The state after an observation (ALIVE, REMOVED, UNKNOWN) at a time in seconds. state: struct(status, first_removed, unknowns, next_check)."""
    known = kind == "REMOVED"
    earlier = state["first_removed"]
    confirmed = known & earlier.isNotNull() & (at - earlier >= CONFIRM_HOURS * 3600)
    misses = F.when(kind == "UNKNOWN", state["unknowns"] + 1).otherwise(0)
    wait = F.when(misses == 1, BACK_OFF[0]).when(misses == 2, BACK_OFF[1]).otherwise(BACK_OFF[2])
    after = F.struct(
        F.when(confirmed, "REMOVED").when(known, "SUSPECTED").when(kind == "ALIVE", "ALIVE").otherwise(state["status"]).alias("status"),
        F.when(kind == "ALIVE", F.lit(None).cast("long")).when(known, F.coalesce(earlier, at)).otherwise(earlier).alias("first_removed"),
        misses.cast("int").alias("unknowns"),
        F.when(kind == "UNKNOWN", at + wait * 3600).when(known, at + CONFIRM_HOURS * 3600).otherwise(at + 86400).alias("next_check"),
    )
    return F.when(state["status"] == "REMOVED", state).otherwise(after)


STATE = "struct<status:string,first_removed:bigint,unknowns:int,next_check:bigint>"


def fold_states(observations: DataFrame, key: str, kind: str, at: str) -> DataFrame:
    """Each key's state after its observations in order of time (and kind): what transition() gives step by step, by windows that spill.

    Observations between two that are ALIVE are a segment, whose first removal a later one may confirm; the first confirmed
    removal of a key is its last state, else its last observation tells the state. No history is gathered into a row.
    """
    rows = observations.select(F.col(key), F.col(kind).alias("_kind"), F.col(at).cast("long").alias("_at"))
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_at", "_kind")))
    rows = rows.withColumn("_segment", F.count_if(c("_kind") == "ALIVE").over(w)).withColumn("_known", F.count_if(c("_kind") != "UNKNOWN").over(w))
    rows = rows.withColumn("_last", F.last(F.when(c("_kind") != "UNKNOWN", c("_kind")), ignorenulls=True).over(w))
    within = lambda part: Window.partitionBy(key, part).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_first", F.min(F.when(c("_kind") == "REMOVED", c("_at"))).over(within("_segment")))
    rows = rows.withColumn("_misses", F.count_if(c("_kind") == "UNKNOWN").over(within("_known")).cast("int"))
    confirmed = (c("_kind") == "REMOVED") & (c("_at") - c("_first") >= CONFIRM_HOURS * 3600)
    wait = F.when(c("_misses") == 1, BACK_OFF[0]).when(c("_misses") == 2, BACK_OFF[1]).otherwise(BACK_OFF[2])
    state = F.struct(
        "_n",
        F.when(confirmed, "REMOVED").when(c("_last") == "REMOVED", "SUSPECTED").otherwise(F.coalesce("_last", F.lit("NEW"))).alias("status"),
        c("_first").alias("first_removed"),
        c("_misses").alias("unknowns"),
        (c("_at") + F.when(c("_kind") == "UNKNOWN", wait * 3600).when(c("_kind") == "REMOVED", CONFIRM_HOURS * 3600).otherwise(86400)).alias("next_check"),
    )
    ends = rows.groupBy(key).agg(F.min(F.when(confirmed, state)).alias("_done"), F.max(state).alias("_end"))
    return ends.select(key, F.coalesce("_done", "_end").alias("s")).select(key, "s.status", "s.first_removed", "s.unknowns", "s.next_check")


def versions_on_change(rows: DataFrame, key: str, order: str, content: Column) -> DataFrame:
    """Rows where the content differs from the one before of the same key, numbered from 1."""
    w = Window.partitionBy(key).orderBy(order)
    changed = rows.withColumn("_c", content).withColumn("_p", F.lag("_c").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("_c")))
    return changed.withColumn("version", F.row_number().over(w)).drop("_c", "_p")


def upsert(old: DataFrame, new: DataFrame, key: str, latest: list[str], rules: dict[str, str]) -> DataFrame:
    """A keyed merge: `latest` columns are the new value if it is not null; rules give 'max' or 'min' for others. Late rows never lower a maximum."""
    a = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in [*latest, *rules]])
    b = new.select(F.col(key).alias("_n"), *[F.col(c).alias(f"_n_{c}") for c in [*latest, *rules]])
    j = a.join(b, F.col("_k") == F.col("_n"), "full_outer")
    out = [F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in latest]
    out += [(F.greatest if how == "max" else F.least)(f"_n_{c}", f"_o_{c}").alias(c) for c, how in rules.items()]
    return j.select(F.coalesce("_k", "_n").alias(key), *out)
