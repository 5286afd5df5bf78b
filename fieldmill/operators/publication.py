"""What may be shown: eligibility, freshness of the original offer, precedence of sources, plans of groups and bounded reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days for which an original offer, and a candidate for a duplicate, counts as recent.
PUBLIC_DAYS, CANDIDATE_DAYS = 30, 45


def eligible(status: Column, availability: Column, approved: Column, supply: Column, offer: Column, fresh: Column, override: Column | None = None) -> Column:
    """Public eligibility as one predicate: active, neither rented nor removed, approved, an offer of supply, not for sale, fresh. override lets a reviewer see all."""
    unknown = F.coalesce(availability, F.lit("unknown"))
    public = (status == "active") & ~unknown.isin("rented", "removed") & approved & supply & (F.lower(F.coalesce(offer, F.lit(""))) != "sale") & fresh
    public = F.coalesce(public, F.lit(False))
    return public if override is None else public | F.coalesce(override, F.lit(False))


def in_area(key: Column, label: Column, keys: list[str], labels: list[str]) -> Column:
    """Whether a record lies in one of the areas: by its canonical key, or by its raw label where it has no key."""
    return F.coalesce(F.when(key.isNotNull(), key.isin(*keys)).otherwise(F.lower(F.trim(label)).isin(*[x.lower() for x in labels])), F.lit(False))


def fresh_originals(occurrences: DataFrame, now: Column) -> DataFrame:
    """listing, eligible. occurrences: listing, id, item, published, first_seen, last_seen, ended, changed (days as numbers), is_current, alive, result.

    The earliest published occurrence, history included, is the original; later copies never renew it, a confirmed edit
    does. One without a date passes. A removed original fails unless the same item was seen again after it had ended.
    """
    order = [F.col("published").asc_nulls_last(), F.col("first_seen").asc_nulls_first(), F.col("id").asc()]
    first = occurrences.withColumn("_r", F.row_number().over(Window.partitionBy("listing").orderBy(*order))).where("_r = 1").drop("_r")
    again = occurrences.where("is_current").groupBy(F.col("listing").alias("_l"), F.col("item").alias("_i")).agg(F.max("last_seen").alias("_seen"))
    j = first.join(again, (F.col("listing") == F.col("_l")) & (F.col("item") == F.col("_i")), "left")
    gone = ~F.col("is_current") & ~F.col("alive") & (F.col("result") == "REMOVED") & ~F.coalesce(F.col("_seen") > F.col("ended"), F.lit(False))
    recent = F.greatest("published", F.coalesce("changed", "published")) >= now - PUBLIC_DAYS
    return j.select("listing", F.when(F.coalesce(gone, F.lit(False)), False).when(F.col("published").isNull(), True).otherwise(recent).alias("eligible"))


def by_precedence(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of the sources with the number of their source, and of each key only those of the first source that has it."""
    parts = [df.withColumn("precedence", F.lit(i)) for i, df in enumerate(sources)]
    every = parts[0]
    for df in parts[1:]:
        every = every.unionByName(df)
    least = every.groupBy(F.col(key).alias("_k")).agg(F.min("precedence").alias("_p"))
    return every.join(least, (F.col(key) == F.col("_k")) & (F.col("precedence") == F.col("_p")), "left_semi")


def recent_of_area(rows: DataFrame, area: list[str], updated: str, now: Column, most: int, tie: str) -> DataFrame:
    """Of each area the `most` last updated rows of the last CANDIDATE_DAYS days."""
    w = Window.partitionBy(*area).orderBy(F.desc(updated), F.asc(tie))
    return rows.where(F.col(updated) >= now - F.expr(f"INTERVAL {CANDIDATE_DAYS} DAYS")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def by_typed_key(left: DataFrame, right: DataFrame, alias: str, ident: str, space: str) -> DataFrame:
    """Rows of left whose text alias, of the form space:number, names a row of right; the number is the key, so nothing is compared as text."""
    number = F.try_to_number(F.regexp_extract(F.col(alias), f"^{space}:([0-9]{{1,18}})$", 1), F.lit("9" * 18)).cast("long")
    return left.withColumn("_key", number).join(right, F.col("_key") == F.col(ident)).drop("_key")


#: The largest integer that a double holds apart from its neighbours, which is what clients' numbers can be.
SAFE_INTEGER = (1 << 53) - 1


def strict_integer(value: Column, least: int = 0, scale: int = 1, most: int = SAFE_INTEGER) -> Column:
    """A parameter's text as an integer times scale; null where it is not one, is under `least`, or is beyond `most`, which a 64-bit key's bound may be."""
    text = F.trim(value)
    parsed = F.when(text.rlike(r"^[+-]?[0-9]+$"), F.regexp_replace(text, r"^\+", "").try_cast("long"))
    wide = parsed.cast("decimal(38,0)")
    return F.when((parsed >= least) & (F.abs(wide) <= most) & (F.abs(wide * scale) <= most), parsed * scale)


def strict_decimal(value: Column) -> Column:
    """A parameter's text as a finite number; null where it is not one."""
    text = F.trim(value)
    parsed = F.when(text.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(parsed) < float("inf"), parsed)


def plan_groups(groups: DataFrame, now: Column, most: int) -> DataFrame:
    """The plan of each group to read: limit, interval_hours, due, score. groups: url, priority, and of its history (null if there is
    none) seen (number of observations), first, last (hours), rate, coverage, ordering, demand, supply.

    Groups new to the monitor are read every 12 hours at least, quiet ones every 24; a gap or a wrong order shortens that to 2.
    """
    c = F.col
    odd = F.coalesce((c("coverage") == "possible_gap") | (c("ordering") == "non_chronological"), F.lit(False))
    fresh = c("seen").isNull() | (c("seen") < 3) | (now - c("first") < 72)
    limit = F.least(F.lit(most), F.greatest(F.lit(10), F.when(odd, 80).otherwise(50)))
    traffic = F.when(c("rate") > 0, limit * 0.55 / c("rate")).otherwise(24)
    hours = F.least(F.when(fresh, 12).otherwise(24), F.greatest(F.lit(1), traffic))
    hours = F.when(odd, F.least(hours, F.lit(2))).otherwise(hours)
    late = now - (c("last") + hours)
    score = (
        F.when(c("priority") == "A", 30).when(c("priority") == "B", 20).otherwise(10)
        + F.least(F.lit(25), F.coalesce(c("rate"), F.lit(0)) * 2)
        + F.when(c("coverage") == "possible_gap", 50).otherwise(0)
        + F.when(c("ordering") == "non_chronological", 30).otherwise(0)
        + F.coalesce(c("demand"), F.lit(0)) * 3
        + F.least(F.lit(15), F.coalesce(c("supply"), F.lit(0)))
        + F.when(c("last").isNull(), 40).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), late)))
    )
    due = F.coalesce(late >= 0, F.lit(True))
    return groups.select("url", limit.cast("int").alias("limit"), F.round(hours.cast("double"), 2).alias("interval_hours"), due.alias("due"), F.floor(score + 0.5).cast("long").alias("score"))


def greedy(df: DataFrame, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Admits rows in order while their whole-number cost fits what is left of the budget, and passes over those that do not fit.

    What is left never grows, so of each cost only the first budget / cost rows can be admitted: some budget * log(budget)
    rows, whatever the input, are walked in one task. Rows that cost nothing are always admitted; a null cost never is.
    """
    free = df.where(F.col(cost) <= 0)
    rows = df.where((F.col(cost) > 0) & (F.col(cost) <= budget)).withColumn("_n", F.row_number().over(Window.partitionBy(cost).orderBy(*order)))
    rows = rows.where(F.col("_n") <= F.floor(F.lit(budget) / F.col(cost))).drop("_n")
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        pdf = pdf.sort_values("_rank")
        for c in pdf[cost]:
            keep.append(c <= left)
            left -= c if keep[-1] else 0
        return pdf[keep].drop(columns=["_rank", "_all"])

    return free.unionByName(rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(walk, df.schema))


def budget_sums(runs: DataFrame, at: str, cost: str, state: str, month: Column) -> DataFrame:
    """spent (runs done in the month) and reserved (open runs of any time), as one row."""
    spent = F.when((F.col(state) == "done") & (F.date_trunc("month", F.col(at)) == F.date_trunc("month", month)), F.col(cost))
    return runs.agg(F.coalesce(F.sum(spent), F.lit(0)).alias("spent"), F.coalesce(F.sum(F.when(F.col(state) == "open", F.col(cost))), F.lit(0)).alias("reserved"))


def tallies_with_recent(rows: DataFrame, kind: str, at: str, ident: str, most: int) -> DataFrame:
    """kind, n, recent: how often each kind occurs and the identifiers of its last `most` rows, newest first."""
    n = rows.groupBy(kind).agg(F.count("*").alias("n"))
    w = Window.partitionBy(kind).orderBy(F.desc(at), F.desc(ident))
    last = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    recent = last.groupBy(kind).agg(F.array_sort(F.collect_list(F.struct("_r", ident))).alias("_l")).select(F.col(kind).alias("_k"), F.transform("_l", lambda x: x[ident]).alias("recent"))
    return n.join(recent, F.col(kind) == F.col("_k")).select(kind, "n", "recent")


def repost_report(members: DataFrame, methods: DataFrame) -> DataFrame:
    """One row: clusters, singletons, multi, collapsed (members beyond the first), largest, cross_group and by_method. members: cluster, id, grp; methods: cluster, method."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.min("grp").alias("a"), F.max("grp").alias("b"))
    one = sizes.agg(
        F.count("*").alias("clusters"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") > 1).alias("multi"), F.sum(F.col("n") - 1).alias("collapsed"),
        F.max("n").alias("largest"), F.count_if(F.col("a") != F.col("b")).alias("cross_group"),
    )
    kinds = methods.groupBy("method").agg(F.count("*").alias("n"))
    text = kinds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("method", "n"))), lambda x: F.concat_ws(":", x["method"], x["n"].cast("string"))), ",").alias("by_method"))
    return one.withColumn("_k", F.lit(0)).join(text.withColumn("_k", F.lit(0)), "_k").drop("_k")  # one row each


def diagnostics(edges: DataFrame, least: float = 0.66, same_text: float = 0.86) -> DataFrame:
    """Pairs that no rule accepts but that deserve a look: kind near_threshold, or same_agent_different_text. edges: a, b, similarity, accepted, shared_phone."""
    kinds = F.array_compact(F.array(F.when(F.col("similarity") >= least, F.lit("near_threshold")), F.when(F.col("shared_phone") & (F.col("similarity") < same_text), F.lit("same_agent_different_text"))))
    return edges.where(~F.col("accepted")).select("a", "b", "similarity", F.explode(kinds).alias("kind"))


def location_text(x: Column) -> Column:
    """A place's name for comparison: a-z and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def script_share(x: Column, letters: str, threshold: float = 0.10) -> Column:
    """Whether more than a share of a trimmed text's characters are of a script (a character class); not for null or blank texts."""
    text = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))
    own = F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    return (F.length(text) > 0) & (own > threshold * F.length(text))


def canonical_tags(tags: Column, synonyms: dict[str, str], allowed: list[str]) -> Column:
    """Tags by a table of synonyms, else in title case; those that are allowed, each once, in their order."""
    known = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair]) if synonyms else F.create_map().cast("map<string,string>")
    named = F.transform(tags, lambda t: F.coalesce(known[F.lower(F.trim(t))], F.initcap(F.trim(t))))
    return F.array_distinct(F.filter(named, lambda t: t.isin(*allowed)))
