"""The funnel report as one result."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.operators.analytics import search_context, time_to_convert
from fieldmill.operators.components import _cut

REPORT = "section string, rank long, name string, value double"


def percentage(part: Column, whole: Column) -> Column:
    """Rounded to two places; null of an empty whole."""
    return F.when(whole > 0, F.round(100.0 * part / whole, 2))


def funnel_report(events: DataFrame, begin: datetime, end: datetime, internal: list[str], top: int = 10) -> DataFrame:
    """section, rank, name, value: stages and rates, repeated dispatches, interests a user, contexts, top lists, time from view to interest.

    events: id, actor, item (may be null), kind (view, interest, grant or dispatch), at, context (JSON of an interest).
    The period is half-open; internal actors are left out. One pass counts each actor's events of an item, and all but
    contexts and times are sums over these pairs. Rates follow users and items that have both stages; of a top list's
    ties the least name comes first; without events, counts are 0, and rates, the average and the median null.
    """
    e = events.where((F.col("at") >= F.lit(begin)) & (F.col("at") < F.lit(end)) & F.col("kind").isin("view", "interest", "grant", "dispatch") & ~F.col("actor").isin(internal))
    kinds = ("view", "interest", "grant", "dispatch")
    pairs = _cut(e.groupBy("actor", "item").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds]))

    def lines(section: str, one: DataFrame) -> DataFrame:
        """A row for each column of a single row, in their order."""
        each = [F.struct(F.lit(section).alias("section"), F.lit(i).cast("long").alias("rank"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for i, c in enumerate(one.columns, 1)]
        return one.select(F.explode(F.array(*each)).alias("r")).select("r.*")

    def ranked(section: str, rows: DataFrame) -> DataFrame:
        """The first rows of name, n; at most `top` of them are gathered."""
        best = rows.orderBy(F.desc("n"), "name").limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "name"))).alias("l"))
        return best.select(F.posexplode("l").alias("i", "x")).select(F.lit(section).alias("section"), (F.col("i") + 1).cast("long").alias("rank"), F.col("x.name").alias("name"), (-F.col("x.n")).cast("double").alias("value"))

    def having(key: str) -> DataFrame:
        """How many of the actors or items have each kind, and both of the first two."""
        of = pairs.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(k).alias(k) for k in kinds])
        return of.agg(*[F.count_if(F.col(k) > 0).alias(f"{key}_{k}") for k in kinds], F.count_if((F.col("view") > 0) & (F.col("interest") > 0)).alias(f"{key}_both"))

    sums = pairs.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds])
    one = having("actor").crossJoin(having("item")).crossJoin(sums)  # one row each
    funnel = one.select(
        *[x for k in ("view", "interest", "dispatch") for x in (F.col(f"actor_{k}").alias(f"{k}_users"), F.col(f"item_{k}").alias(f"{k}_items"), F.col(k).alias(f"{k}_events"))],
        percentage(F.col("actor_both"), F.col("actor_view")).alias("view_to_interest_user_rate"),
        percentage(F.col("item_both"), F.col("item_view")).alias("viewed_to_interested_item_rate"),
        percentage(F.col("grant"), F.col("interest")).alias("grants_per_interest"),
    )
    sent = pairs.where("item IS NOT NULL AND dispatch > 0")
    dispatch = sent.agg(F.count("*").alias("pairs"), (F.coalesce(F.sum("dispatch"), F.lit(0)) - F.count("*")).alias("repeat_events"), F.count_if(F.col("dispatch") > 1).alias("pairs_with_repeats"))
    users = pairs.groupBy("actor").agg(F.sum("interest").alias("n")).where("n > 0")
    per_user = users.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") > 1).alias("several"), F.round(F.avg("n"), 2).alias("average"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    kind = e.where("kind = 'interest'").select(search_context(F.col("context")).alias("c"))
    context = kind.agg(*[F.count_if(F.col("c") == c).alias(c) for c in ("direct", "broad", "filtered", "invalid")])
    times = time_to_convert(e.where("item IS NOT NULL"), ["actor", "item"], "at", "kind", "view", "interest", "id")
    times = times.crossJoin(sums).select(F.col("conversions").alias("matched"), (F.col("interest") - F.col("conversions")).alias("unmatched"), "median_seconds")
    return reduce(
        DataFrame.unionByName,
        [
            lines("funnel", funnel), lines("dispatch", dispatch), ranked("repeated_pairs", sent.where("dispatch > 1").select(F.concat_ws("|", "actor", "item").alias("name"), F.col("dispatch").alias("n"))),
            lines("interests_per_user", per_user), lines("context", context), ranked("top_items", pairs.where("item IS NOT NULL").groupBy(F.col("item").alias("name")).agg(F.sum("interest").alias("n")).where("n > 0")),
            lines("view_to_interest", times),
        ],
    )
