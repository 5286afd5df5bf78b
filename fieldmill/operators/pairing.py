"""Greedy one-to-one matching in few rounds, interval joins by buckets, clusters mended where signals changed, deletes over a graph of tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from fieldmill.operators.components import _cut, near_components, shared_folder
from fieldmill.operators.shaping import star_links

# One-to-one matching.

#: States of a vertex: matched with the vertex that it points at (M), left by it (F), not known in this round (U).
STATES = "MFU"


#: Nodes of a range whose pointers are followed in one task, about.
RANGE_NODES = 200_000


def _followed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """node, up, f of _resolved()'s nodes, pointers followed as far as they stay in a range of the order: a task takes its rows in order, so what a node points at came before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str | None, str]] = {}
        for b in batches:
            names, ups, fs = (b[c].to_pylist() for c in ("node", "up", "f"))
            for i, (node, up, f) in enumerate(zip(names, ups, fs)):
                if up is not None and (above := seen.get(up)) is not None:
                    up, f = above[0], "".join([f[STATES.index(x)] for x in above[1]])
                    ups[i], fs[i] = up, f
                seen[node] = up, f
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(ups, pa.string()), pa.array(fs, pa.string())], names=["node", "up", "f"])

    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // RANGE_NODES)
    rows = nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.select("node", "up", "f").mapInArrow(run, "node string, up string, f string")


def _resolved(nodes: DataFrame, order: list[Column], most_jumps: int = 60) -> DataFrame:
    """node, state from node, up (null at a root), f: the states that M, F and U of `up` give the node, as three letters. A root's f is its state thrice.

    A node comes after the one it points at in the order. Pointers are first followed within ranges of it, so what is left
    of a path has a node for each range at most; then only the nodes that some other range points at jump: each jump
    composes a node's f with that of the node it points at and moves the pointer on, so n ranges take log2(n) jumps.
    """
    all_ = _cut(_followed(_cut(nodes), order))
    ended = all_.where("up IS NULL").select("node", F.substring("f", 1, 1).alias("state"))
    open_ = all_.where("up IS NOT NULL")
    cur = _cut(all_.join(open_.select(F.col("up").alias("node")).distinct().hint("merge"), "node", "left_semi"))
    for _ in range(most_jumps):
        if cur.where("up IS NOT NULL").isEmpty():
            above = cur.select(F.col("node").alias("_n"), F.col("f").alias("_f"))
            late = open_.join(above.hint("merge"), F.col("up") == F.col("_n")).select("node", F.substring(_translate(F.col("_f"), F.col("f")), 1, 1).alias("state"))
            return ended.unionByName(late)
        above = cur.select(F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("f").alias("_f"))
        j = cur.join(above.hint("merge"), F.col("up") == F.col("_n"), "left")
        cur = _cut(j.select("node", F.col("_up").alias("up"), F.when(F.col("up").isNull(), F.col("f")).otherwise(_translate(F.col("_f"), F.col("f"))).alias("f")))
    raise RuntimeError("pointers did not end")


def _translate(above: Column, f: Column) -> Column:
    """Each letter of `above` replaced by what f has for it."""
    letters = [F.element_at(F.split(f, ""), F.instr(F.lit(STATES), F.substring(above, i, 1))) for i in (1, 2, 3)]
    return F.concat(*letters)


def greedy_pairs(pairs: DataFrame, least: float = 0.55, most_rounds: int = 50) -> DataFrame:
    """a, b, score of the matching that takes pairs from the best score down (ties: least a, then least b) and passes over used items.

    Every item points at its best pair's other side; pointers rise in score and end in two items that point at each
    other, which are matched. An item that its choice leaves takes its next best pair if that item points at it, else it
    waits for the next round. So along a path of pointers items are matched and left by turns, and one round decides all
    trees of pointers by following them: a chain of any length ends in a round or two, not in one for each pair. Pairs of a null
    item or score, and those under `least`, are left out; of repeated pairs the best score counts.

    All joins are by sorting: sizes guessed from a compressed file are far under those of its rows as pairs and nodes, and
    a side taken for small would be gathered by the driver to be broadcast.
    """
    cols = ["a", "b", "score"]
    cur = _cut(pairs.select(*cols).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("score") >= least)).groupBy("a", "b").agg(F.max("score").alias("score")))
    out = cur.limit(0)
    for _ in range(most_rounds):
        if cur.isEmpty():
            return out.select(*cols)
        # Both sides' view of each pair; an item's two best are kept by a limit within groups.
        one = cur.select(F.concat(F.lit("a"), F.col("a").cast("string")).alias("node"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("other"), *cols)
        both = one.unionAll(one.select(F.col("other").alias("node"), F.col("node").alias("other"), *cols))
        w = Window.partitionBy("node").orderBy(F.desc("score"), "a", "b")
        ranked = both.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
        first = ranked.where("_r = 1").select("node", F.col("other").alias("up"), *cols)
        first = _cut(first)
        second = ranked.where("_r = 2").select(F.col("node").alias("_n"), F.col("other").alias("_second"))
        back = first.select(F.col("node").alias("_m"), F.col("up").alias("_back"))
        # What an item gives those that point at it: its choice besides its own pointer, and whether that one points back.
        j = first.join(second.hint("merge"), F.col("node") == F.col("_n"), "left").drop("_n")
        j = j.join(back.hint("merge"), F.col("_second") == F.col("_m"), "left").drop("_m")
        giving = _cut(j.select(F.col("node").alias("_g"), F.col("up").alias("_gup"), "_second", (F.col("_second").isNull() | F.coalesce(F.col("_back") == F.col("node"), F.lit(False))).alias("_safe")))
        k = first.join(giving.hint("merge"), F.col("up") == F.col("_g"))
        root = F.col("_gup") == F.col("node")
        chosen = F.coalesce(F.col("_second") == F.col("node"), F.lit(False))
        f = F.when(root, "MMM").when(~F.col("_safe"), "FUU").when(chosen, "FMU").otherwise("FFU")
        nodes = k.select("node", F.when(~root, F.col("up")).alias("up"), f.alias("f"), *cols)
        state = _resolved(nodes, [F.desc("score"), F.asc("a"), F.asc("b")])
        matched = state.where("state = 'M'").join(first.hint("merge"), "node").select(*cols).distinct()
        matched = _cut(matched)
        out = out.unionByName(matched)
        cur = _cut(cur.join(matched.select("a").hint("merge"), "a", "left_anti").join(matched.select("b").hint("merge"), "b", "left_anti").select(*cols))
    raise RuntimeError(f"pairs left after {most_rounds} rounds")


# Interval join.


def interval_join(points: DataFrame, ranges: DataFrame, keys: list[tuple[str, str]], value: str, low: str, high: str, width: float, most_points: int = 100_000) -> DataFrame:
    """Rows of points and ranges with equal keys and low <= value <= high; a null bound is open, a null value is in no range. Column names must differ.

    A range is cut into the buckets of `width` that it covers: between the points' least and greatest bucket, however
    far it reaches. Bounds are only checked in its two outermost buckets. A bucket with more than `most_points` points
    is split: its points are dealt by a hash into shares, and ranges go to each of them, so no key holds more.
    """
    p = points.where(F.col(value).isNotNull()).withColumn("_bucket", F.floor(F.col(value) / width))
    own = [F.col(a) for a, _ in keys]
    counts = p.groupBy(*own, "_bucket").agg(F.count("*").alias("_n"))
    shares = counts.select(*[F.col(a).alias(f"_k{i}") for i, (a, _) in enumerate(keys)], F.col("_bucket").alias("_kb"), F.ceil(F.col("_n") / most_points).cast("int").alias("_shares"))
    ends = counts.agg(F.min("_bucket").alias("_from"), F.max("_bucket").alias("_to"))
    r = ranges.crossJoin(F.broadcast(ends))  # one row
    r = r.withColumn("_lb", F.floor(F.col(low) / width)).withColumn("_hb", F.floor(F.col(high) / width))
    r = r.withColumn("_b0", F.greatest("_lb", "_from")).withColumn("_b1", F.least("_hb", "_to")).where("_b0 <= _b1")
    r = r.withColumn("_kb", F.explode(F.sequence("_b0", "_b1"))).withColumn("_edge", F.coalesce((F.col("_kb") == F.col("_lb")) | (F.col("_kb") == F.col("_hb")), F.lit(False)))
    on = [F.col(b) == F.col(f"_k{i}") for i, (_, b) in enumerate(keys)]
    r = r.join(shares, [*on, r["_kb"] == shares["_kb"]]).drop(shares["_kb"]).drop(*[f"_k{i}" for i in range(len(keys))])
    r = r.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    of = shares.withColumnsRenamed({"_shares": "_s"})
    on = [F.col(a) == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)]
    p = p.join(of, [*on, F.col("_bucket") == of["_kb"]]).drop("_kb", *[f"_k{i}" for i in range(len(keys))])
    p = p.withColumn("_part", F.when(F.col("_s") > 1, F.pmod(F.xxhash64(*[F.col(c) for c in points.columns]), F.col("_s"))).otherwise(0).cast("int"))
    inside = ~F.col("_edge") | ((F.col(low).isNull() | (F.col(value) >= F.col(low))) & (F.col(high).isNull() | (F.col(value) <= F.col(high))))
    j = p.join(r, [*[F.col(a) == F.col(b) for a, b in keys], F.col("_bucket") == F.col("_kb"), F.col("_part") == F.col("_share")])
    return j.where(inside).select(*points.columns, *ranges.columns)


def least_of_ranges(ranges: DataFrame, keys: list[str], low: str, high: str, ident: str) -> DataFrame:
    """keys, start, open, end, closed, ident: for each key the stretches of a line on which some range lies, with the least ident there.

    A range has both its ends, a null end is open. A stretch begins with `start` itself or, if open, just behind it, and ends
    with `end` itself if closed, else just before it; a null end is none. A key's ends pass one task in order, and a heap holds
    the ranges under way, so its stretches are at most twice its ranges, however these overlap.
    """
    known = [f.name for f in ranges.schema if f.name in keys]
    inf = float("inf")
    r = ranges.where(F.col(ident).isNotNull()).select(*known, F.coalesce(F.col(low).cast("double"), F.lit(-inf)).alias("_low"), F.coalesce(F.col(high).cast("double"), F.lit(inf)).alias("_high"), F.col(ident).cast("long").alias("_id")).where("_low <= _high")
    ends = r.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", F.when(F.col("_end") == 0, F.col("_low")).otherwise(F.col("_high")))
    columns = [*known, "_at", "_end", "_high", "_id"]
    rows = ends.repartition(*known).sortWithinPartitions(*known, "_at", "_end").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heap, now = None, [], None  # now: least ident, start, open
        for b in batches:
            out: list[tuple] = []

            def close(at: float, closed: bool) -> None:
                if now is not None and (now[1] < at or (closed and not now[2])):
                    out.append((*key, now[1], now[2], at, closed, now[0]))

            for *k, at, end, high_, i in zip(*(b[c].to_pylist() for c in columns)):
                if k != key:
                    key, heap, now = k, [], None
                if end == 0:
                    heappush(heap, (i, high_))
                    if now is None or i < now[0]:
                        close(at, False)
                        now = (i, at, False)
                elif now is not None and i == now[0]:
                    # Ranges that end here end together; one that begins here has been taken in before.
                    while heap and heap[0][1] <= at:
                        heappop(heap)
                    if not heap or heap[0][0] != i:
                        close(at, True)
                        now = (heap[0][0], at, True) if heap else None
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], names=[*known, "start", "open", "end", "closed", ident])

    schema = StructType([*(ranges.schema[k] for k in known), StructField("start", DoubleType()), StructField("open", BooleanType()), StructField("end", DoubleType()), StructField("closed", BooleanType()), StructField(ident, LongType())])
    types = [f.type for f in to_arrow_schema(schema)]
    return rows.mapInArrow(run, schema)


def first_of_ranges(points: DataFrame, point: str, ranges: DataFrame, keys: list[tuple[str, str]], by: list[str], value: str, low: str, high: str, ident: str, buckets: int = 1 << 12) -> DataFrame:
    """point, by, ident: for each point and value of `by` the least ident of the ranges that hold it. keys: equal columns of both.

    What a point may meet is not every range but the stretches of least_of_ranges() in its own part of the line, at each
    place one for each value of `by`. Parts are buckets of equal width between the points' ends.
    """
    right = [b for _, b in keys]
    of = least_of_ranges(ranges, [*right, *by], low, high, ident)
    p = points.where(F.col(value).isNotNull()).select(point, *[a for a, _ in keys], F.col(value).cast("double").alias("_v"))
    ends = p.agg(F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    bucket = lambda c: F.when(F.col("_to") > F.col("_from"), F.floor((F.col(c) - F.col("_from")) / (F.col("_to") - F.col("_from")) * buckets)).otherwise(F.lit(0).cast("long"))
    s = of.crossJoin(F.broadcast(ends)).where((F.col("start") <= F.col("_to")) & (F.col("end") >= F.col("_from")))  # one row
    s = s.withColumn("_s", F.greatest("start", "_from")).withColumn("_e", F.least("end", "_to")).withColumn("_b", F.explode(F.sequence(bucket("_s"), bucket("_e"))))
    p = p.crossJoin(F.broadcast(ends)).withColumn("_pb", bucket("_v")).drop("_from", "_to")
    inside = ((F.col("_v") > F.col("start")) | ((F.col("_v") == F.col("start")) & ~F.col("open"))) & ((F.col("_v") < F.col("end")) | ((F.col("_v") == F.col("end")) & F.col("closed")))
    j = p.join(s, [*[F.col(a) == F.col(b) for a, b in keys], F.col("_pb") == F.col("_b")]).where(inside).select(point, *by, ident)
    if p.groupBy(point).count().where("count > 1").isEmpty():
        return j
    return j.groupBy(point, *by).agg(F.min(ident).alias(ident))


# Clusters mended where signals changed.

#: Files of a bucket, at most; each is written by one task.
SHARES = 4


class SignalIndex:
    """Signals (id, signal) in two tables in the shared folder, by bucket of the signal and by bucket of the identifier, so that a look-up reads the buckets it asks for."""

    def __init__(self, spark: SparkSession, signals: DataFrame | None = None, path: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = path or os.path.join(shared_folder(spark), f"signals-{uuid.uuid4().hex}")
        #: Buckets of each look-up so far, by table.
        self.read: list[tuple[str, int]] = []
        if signals is not None:
            rows = signals.select("id", "signal").where("id IS NOT NULL AND signal IS NOT NULL")
            for by in ("id", "signal"):
                # Equal rows lie in the same share, so that telling them apart takes no shuffle of its own.
                dealt = rows.withColumn("bucket", self._bucket(by)).withColumn("_share", F.pmod(F.hash("id"), F.lit(SHARES))).repartition("bucket", "_share")
                dealt.distinct().drop("_share").write.partitionBy("bucket").parquet(f"{self.path}/{by}")
                rows = self.rows()

    def _bucket(self, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """All signals, each row once."""
        return self.spark.read.parquet(f"{self.path}/id").select("id", "signal")

    def find(self, by: str, wanted: DataFrame) -> DataFrame:
        """The signals whose `by` is wanted; the number of buckets bounds what the driver gets."""
        hit = sorted(r["b"] for r in wanted.select(self._bucket(by).alias("b")).distinct().collect())
        self.read.append((by, len(hit)))
        rows = self.spark.read.parquet(f"{self.path}/{by}").where(F.col("bucket").isin(hit) if hit else F.lit(False))
        return rows.join(wanted, by, "left_semi").select("id", "signal")


def frontier(index: SignalIndex, changed: DataFrame, old: DataFrame, most_rounds: int = 100) -> DataFrame:
    """id of all items that a chain of shared signals or of old clusters (id, cluster) links to a changed one, the changed ones included. Each round looks up the signals of what the round before added."""
    return _linked(index, changed, old, most_rounds)[0]


def _linked(index: SignalIndex, changed: DataFrame, old: DataFrame, most_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """The items of frontier() and their signals. A round takes the old clusters of what it reaches at once, so where only changed items' signals differ from those of the old clusters the second round finds nothing."""
    known = old.select("id", "cluster")
    new = _cut(changed.select("id").where("id IS NOT NULL").distinct())
    seen, signals, alone = new, None, new
    for _ in range(most_rounds):
        found = _cut(index.find("id", new))
        fresh = found.select("signal").distinct()
        fresh = _cut(fresh if signals is None else fresh.join(signals.select("signal"), "signal", "left_anti"))
        signals = found if signals is None else signals.unionByName(found)
        reached = _cut(index.find("signal", fresh).select("id").distinct().join(seen, "id", "left_anti"))
        alone = reached if alone is None else alone.unionByName(reached)
        if alone.isEmpty():
            return seen, signals
        clusters = known.join(alone, "id", "left_semi").select("cluster").distinct()
        new = _cut(known.join(clusters, "cluster", "left_semi").select("id").unionByName(reached).distinct().join(seen, "id", "left_anti"))
        seen, alone = seen.unionByName(new), None
        if new.isEmpty():
            return seen, signals
    raise RuntimeError(f"no end after {most_rounds} rounds")


def mended_clusters(index: SignalIndex, changed: DataFrame, old: DataFrame) -> DataFrame:
    """id, cluster after a change of some items' signals: only items linked to a changed one are clustered again, under their least identifier; others keep theirs. The index has the new signals, old the former clusters."""
    inside, signals = _linked(index, changed, old)
    edges = star_links(signals).join(old.select(F.col("id").alias("b"), "cluster"), "b", "left").select("a", "b", F.coalesce("cluster", "b").alias("near"))
    of = near_components(edges, "a", "b", "near")
    again = inside.join(of, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))
    return old.select("id", "cluster").join(inside, "id", "left_anti").unionByName(again)


# Deletes over a graph of tables.


def delete_closure(roots: dict[str, DataFrame], tables: dict[str, tuple[DataFrame, str]], references: list[tuple[str, str, str]], most_rounds: int = 100) -> DataFrame:
    """table, id of the rows that must go when the roots go. tables: name -> rows and key; references: child, its column, parent.

    A child goes if any of its parents does. Tables are worked through parents first, one semi join for each reference;
    tables that refer to themselves or to one another in a circle go round until nothing is added. A null reference
    names no row.
    """
    gone: dict[str, DataFrame] = {t: r.select(F.col(r.columns[0]).cast("string").alias("id")).distinct() for t, r in roots.items()}
    below = {t: {c for c, _, p in references if p == t} for t in tables}

    def reach(t: str) -> set[str]:
        out, todo = set(), [t]
        while todo:
            for c in below[todo.pop()] - out:
                out.add(c)
                todo.append(c)
        return out

    reaches = {t: reach(t) for t in tables}

    def children(names: list[str], of: dict[str, DataFrame]) -> dict[str, DataFrame]:
        found: dict[str, list[DataFrame]] = {}
        for child, column, parent in references:
            if child in names and parent in of:
                rows, key = tables[child]
                hit = rows.select(F.col(key).cast("string").alias("id"), F.col(column).cast("string").alias("_p")).join(of[parent].select(F.col("id").alias("_p")), "_p", "left_semi")
                found.setdefault(child, []).append(hit.select("id"))
        return {c: reduce(DataFrame.unionByName, f).distinct() for c, f in found.items()}

    left = list(tables)
    while left:
        # The next tables that no other one left reaches, unless these are reached back.
        head = next(t for t in left if all(t not in reaches[o] or o in reaches[t] for o in left if o != t))
        circle = [t for t in left if t == head or (t in reaches[head] and head in reaches[t])]
        for t, rows in children(circle, {p: g for p, g in gone.items() if p not in circle}).items():
            gone[t] = gone[t].unionByName(rows).distinct() if t in gone else rows
        if head in reaches[head]:
            gone |= {t: _cut(gone[t]) for t in circle if t in gone}
            new = {t: gone[t] for t in circle if t in gone}
            for _ in range(most_rounds):
                found = children(circle, new)
                new = {t: _cut(rows.join(gone[t], "id", "left_anti") if t in gone else rows) for t, rows in found.items()}
                new = {t: rows for t, rows in new.items() if not rows.isEmpty()}
                if not new:
                    break
                gone |= {t: gone[t].unionByName(rows) if t in gone else rows for t, rows in new.items()}
            else:
                raise RuntimeError(f"no end after {most_rounds} rounds")
        left = [t for t in left if t not in circle]
    spark = next(iter(tables.values()))[0].sparkSession
    parts = [rows.select(F.lit(t).alias("table"), "id") for t, rows in gone.items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "table string, id string")
