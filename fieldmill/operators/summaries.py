"""Smaller reports and filters over listings and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.operators import predicates
from fieldmill.operators.analytics import due_after
from fieldmill.plans.spec import SearchSpec


def in_id_set(rows: DataFrame, key: str, ids: str) -> DataFrame:
    """rows whose key is in a JSON array of numbers, however long: one parameter, parsed by Spark and joined. Anything else than a number names nothing."""
    wanted = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(ids), "array<string>")).alias("_id")).select(F.col("_id").try_cast("long").alias("_id")).distinct()
    return rows.join(wanted, F.col(key) == F.col("_id"), "left_semi")


def due_for_check(rows: DataFrame, posted: str, checked: str, key: str, now: Column, limit: int) -> DataFrame:
    """The first `limit` rows whose last check is older than their age allows: never checked ones first, then the longest waiting, then the least key."""
    age = (F.unix_seconds(now) - F.unix_seconds(F.col(posted).cast("timestamp"))) / 86_400
    wait = F.unix_seconds(now) - F.unix_seconds(F.col(checked).cast("timestamp"))
    due = F.col(checked).isNull() | (wait >= due_after(age) * 3600)
    return rows.where(due).orderBy(F.col(checked).asc_nulls_first(), key).limit(limit)


def facets(rows: DataFrame, columns: list[str], price: str) -> DataFrame:
    """facet, value, n of each column's values and, as facet `price`, the number of rows with its least and greatest known price; 0 where there is none. One pass over the rows, by grouping sets."""
    p = F.when(F.col(price) > 0, F.col(price))
    sets = [[F.col(c)] for c in columns] + [[]]
    of = rows.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.min(p).alias("low"), F.max(p).alias("high"), F.grouping_id().alias("_g"))
    whole = (1 << len(columns)) - 1
    names = F.coalesce(*[F.when(F.col("_g") == whole - (1 << (len(columns) - 1 - i)), F.lit(c)) for i, c in enumerate(columns)], F.lit("price"))
    values = F.coalesce(*[F.when(names == c, F.col(c).cast("string")) for c in columns])
    out = of.select(names.alias("facet"), values.alias("value"), "n", "low", "high").where((F.col("facet") == "price") | F.col("value").isNotNull())
    # No rows make no grouping set at all, so a line of zero rows is added to what is already counted.
    none = rows.sparkSession.range(1).select(F.lit("price").alias("facet"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(out.schema["low"].dataType).alias("low"), F.lit(None).cast(out.schema["high"].dataType).alias("high"))
    end = lambda c: F.when(F.col("facet") == "price", F.coalesce(F.max(c), F.lit(0))).alias(c)
    return out.unionByName(none).groupBy("facet", "value").agg(F.sum("n").alias("n"), end("low"), end("high"))


def warning_histogram(rows: DataFrame, codes: str, at: str, now: Column, top: int = 8, recent_top: int = 10) -> DataFrame:
    """period, rank, code, n: the most frequent codes, what stands before the colon, of all time and of the last day."""
    each = rows.select(F.explode(codes).alias("c"), F.col(at).alias("_at"), now.alias("_now")).select(F.split_part("c", F.lit(":"), F.lit(1)).alias("code"), "_at", "_now")
    last = (F.col("_at") > F.col("_now") - F.expr("INTERVAL 24 HOURS")) & (F.col("_at") <= F.col("_now"))
    n = each.groupBy("code").agg(F.count("*").alias("all"), F.count_if(last).alias("day"))
    each = n.select("code", F.explode(F.array(F.struct(F.lit("all").alias("period"), F.col("all").alias("n"), F.lit(top).alias("most")), F.struct(F.lit("day").alias("period"), F.col("day").alias("n"), F.lit(recent_top).alias("most")))).alias("x")).where("x.n > 0")
    w = Window.partitionBy("period").orderBy(F.desc("n"), "code")  # one row for each code
    return each.select("x.period", "code", "x.n", "x.most").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= most").select("period", "rank", "code", "n")


def mapped_and_unresolved(left: DataFrame, right: DataFrame, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """(key with its targets and their number; rows of left without any). A key with many targets is pre-aggregated to their count, least and greatest."""
    known = right.where(F.col(target).isNotNull()).groupBy(key).agg(F.count_distinct(target).alias("targets"), F.min(target).alias("least"), F.max(target).alias("greatest"))
    return left.join(known, key), left.join(known, key, "left_anti")


def confusion(expected: Column, actual: Column) -> Column:
    """correct, missed, contradicted, unverified or unknown_preserved: what an extracted fact is against the stated one."""
    return F.when(expected.isNull() & actual.isNull(), "unknown_preserved").when(expected.isNull(), "unverified").when(actual.isNull(), "missed").when(expected == actual, "correct").otherwise("contradicted")


def dispositions(rows: DataFrame, key: str, arrival: str, at: str, seen: str | None = None) -> DataFrame:
    """rows with disposition: applied, duplicate (the time of the latest observation before it) or stale (older, or not after the item's own last sight)."""
    before = F.max(at).over(Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1))
    stale = F.col(at) < before if seen is None else (F.col(at) < before) | (F.col(at) <= F.col(seen))
    return rows.withColumn("disposition", F.when(F.coalesce(F.col(at) == before, F.lit(False)), "duplicate").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("applied"))


def page_and_total(page: DataFrame, total: DataFrame) -> DataFrame:
    """The page's rows with the total beside them; an empty page gives one row of nulls with it. total: one row."""
    return total.join(page, F.lit(True), "left")


def searched(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    """The page of a search with the total beside it. A page behind the last match is known to be empty from the total, so nothing is ordered for it."""
    total = predicates.total(rows, spec).first()["total"]
    page = predicates.search(rows, spec) if total > max(spec.offset, 0) else rows.limit(0)
    return page_and_total(page, rows.sparkSession.range(1).select(F.lit(total).cast("long").alias("total")))
