"""Joins and windows that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group. Spark limits groups before the shuffle, so a hot group moves a row a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all cores, by a hash of keys if any are given: for work that a small file's few splits would leave to few tasks."""
    n = max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)


def or_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Rows where one of several key pairs is equal, each once: a union of equi joins in place of a nested loop.

    Each join leaves out what an earlier one gave, so where the columns kept tell all rows of either side apart the parts
    hold no row twice and the joined rows, which may be many more than those of both sides, are not shuffled.
    """
    own, other = [c for c in keep if c in left.columns], [c for c in keep if c not in left.columns]
    sides = (left, own, {a for a, _ in pairs}), (right, other, {b for _, b in pairs})
    left, right = (rows.select(*dict.fromkeys([*kept, *sorted(keys)])).distinct() for rows, kept, keys in sides)
    apart = all(kept and rows.groupBy(*kept).count().where("count > 1").isEmpty() for rows, kept in ((left, own), (right, other)))
    left = spread(left)
    out, before = None, F.lit(False)
    for a, b in pairs:
        same = left[a] == right[b]
        part = left.join(right, same & ~before).select(*keep)
        before = before | F.coalesce(same, F.lit(False))
        out = part if out is None else out.unionByName(part)
    return out if apart else out.distinct()


def asof_join(events: DataFrame, keys: list[str], time: str, is_left: Column, value: Column, name: str, tie: str) -> DataFrame:
    """For rows where not is_left: the last non-null value of earlier or simultaneous is_left rows of the same keys.

    One window over the rows that take part, no range join.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(time), F.when(is_left, 0).otherwise(1), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(name, F.last(F.when(is_left, value), ignorenulls=True).over(w)).where(~is_left)


def interval_pairs(df: DataFrame, keys: list[str], ident: str, time: str, seconds: int) -> DataFrame:
    """Pairs (a, b), a < b, of equal keys at most so many seconds apart.

    Rows are put in buckets of that width and meet those of their own and the next bucket, so a key with many rows is
    compared within short spans only and spreads over as many tasks as it has buckets.
    """
    t = F.unix_seconds(F.col(time).cast("timestamp"))
    left = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(ident).alias("a"), t.alias("ta"), F.explode(F.array(F.floor(t / seconds), F.floor(t / seconds) + 1)).alias("_ba"))
    right = df.select(*keys, F.col(ident).alias("b"), t.alias("tb"), F.floor(t / seconds).alias("_bb"))
    on = [F.col(f"_{k}") == F.col(k) for k in keys]
    same = left.join(right, [*on, F.col("_ba") == F.col("_bb"), F.abs(F.col("ta") - F.col("tb")) <= seconds, F.col("a") != F.col("b")])
    return same.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.abs(F.col("ta") - F.col("tb")).alias("gap")).distinct()


def star_pairs(signals: DataFrame, signal: str = "signal", ident: str = "id") -> DataFrame:
    """(a, b): the least identifier of each signal with every other one. Linear in a signal's rows, whatever its size."""
    return star_links(signals, signal, ident).select("a", "b").distinct()


def star_links(signals: DataFrame, signal: str = "signal", ident: str = "id") -> DataFrame:
    """signal, a, b: star_pairs of each signal by itself, so that a pair occurs as often as signals give it."""
    pivot = signals.groupBy(signal).agg(F.min(ident).alias("a"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return signals.join(pivot, signal).where(F.col(ident) != F.col("a")).select(signal, "a", F.col(ident).alias("b"))


def row_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change (INSERT, UPDATE, DELETE), changed (names of columns), for rows that differ."""
    a = before.select(F.col(key).alias("_a"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = after.select(F.col(key).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col("_a").isNull(), "INSERT").when(F.col("_b").isNull(), "DELETE").when(F.size(changed) > 0, "UPDATE")
    return j.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), F.when(change == "UPDATE", F.array_join(changed, ",")).otherwise("").alias("changed")).where("change IS NOT NULL")


def budgeted(df: DataFrame, order: list[Column], cost: str, budget: int) -> DataFrame:
    """Admits rows in order while the running cost, each 0 or 1, is within the budget; rows that cost nothing are always admitted.

    The least order key beyond the budget is found by taking the first `budget` costly rows, not by a window over all rows.
    """
    free = df.where(F.col(cost) == 0)
    return free.unionByName(df.where(F.col(cost) > 0).orderBy(*order).limit(budget))


def table_digest(df: DataFrame) -> DataFrame:
    """rows and an order-insensitive digest of a table."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
