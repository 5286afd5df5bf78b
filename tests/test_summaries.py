from datetime import datetime, timezone

from pyspark.sql import functions as F

from fieldmill.operators import summaries as S


def test_due_rows_by_age_and_never_checked_first(spark):
    at = lambda *t: datetime(2024, 3, *t, tzinfo=timezone.utc)
    rows = [(1, at(9), at(9, 13)), (2, at(9), at(9, 11)), (3, at(1), at(8)), (4, at(1), at(6)), (5, at(9), None), (6, datetime(2024, 1, 1, tzinfo=timezone.utc), at(4)), (7, datetime(2024, 1, 1, tzinfo=timezone.utc), at(2))]
    df = spark.createDataFrame(rows, "k long, posted timestamp, checked timestamp")
    got = [r["k"] for r in S.due_for_check(df, "posted", "checked", "k", F.lit(at(10)), 9).collect()]
    assert got == [5, 7, 4, 2]  # 12 hours in the first week, three days in the first month, else a week


def test_outcomes_dispositions_and_empty_facets(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, None), (None, 1), (None, None)], "e int, a int")
    assert [r[0] for r in df.select(S.confusion(F.col("e"), F.col("a"))).collect()] == ["correct", "contradicted", "missed", "unverified", "unknown_preserved"]
    seen = spark.createDataFrame([("x", 1, 5, 2), ("x", 2, 5, 2), ("x", 3, 4, 2), ("x", 4, 6, 7), ("y", 1, 1, None)], "k string, n int, at int, seen int")
    assert [r["disposition"] for r in S.dispositions(seen, "k", "n", "at", "seen").orderBy("k", "n").collect()] == ["applied", "duplicate", "stale", "stale", "applied"]
    none = spark.createDataFrame([], "c string, price long")
    assert [tuple(r) for r in S.facets(none, ["c"], "price").collect()] == [("price", None, 0, 0, 0)]
    assert S.in_id_set(spark.range(9), "id", "no list").count() == 0
