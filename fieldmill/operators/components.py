"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset a temporary one, which only a local session may use."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fieldmill-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


#: Removes the shuffle files of an action when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _cut(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint. The shuffle files behind it go at once: left to the driver's garbage collection, those of all rounds pile up on disk."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # a query made under the setting
    finally:
        spark.conf.set(CLEANUP, before)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 50, rounds: int | None = None) -> DataFrame:
    """(node, component): the least node that each node of an edge can reach; after a given number of rounds, some node that it can reach.

    Each round points a node's larger neighbours at its least neighbour, then its smaller ones. The least neighbour is a
    pre-aggregated minimum that is joined back, so a node of any degree is never gathered; rounds are reliable checkpoints.
    Loops and repeated edges are allowed, edges with a null end are left out; no edges give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = _cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    cur, before = e.where("u <> v"), None
    for done in range(most_rounds):
        if done == rounds:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        cur = _cut(small.distinct())
        if rounds is not None:
            continue
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    # Every node of an edge that is no loop is still in cur.
    known = cur.unionByName(cur.select(F.col("v").alias("u"), "v")).unionByName(e.where("u = v"))
    return known.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


#: Edges that a task unites before it gives what it has and begins anew: at the next change of `near`, at four times as many anyhow.
UNITED_EDGES = 100_000


def _united(edges: DataFrame) -> DataFrame:
    """node, component of near, u, v: for each node of the edges that a task unites at once the least node that they link it to."""
    kind = edges.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        done, last = 0, None

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def given() -> pa.RecordBatch:
            nodes = list(up)
            return pa.RecordBatch.from_arrays([pa.array(nodes, as_arrow), pa.array([root(x) for x in nodes], as_arrow)], names=["node", "component"])

        for b in batches:
            as_arrow = b["u"].type
            # The way over numpy takes a tenth of the time, but changes other types than integers.
            columns = (b[c].to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(b[c].type) else b[c].to_pylist() for c in ("near", "u", "v"))
            for near, u, v in zip(*columns):
                if done >= UNITED_EDGES and (near != last or done >= 4 * UNITED_EDGES):
                    yield given()
                    up.clear()
                    done = 0
                done, last, u, v = done + 1, near, root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
        if up:
            yield given()

    rows = edges.hint("rebalance", "near").sortWithinPartitions("near")
    return rows.mapInArrow(run, StructType([StructField("node", kind), StructField("component", kind)]))


def near_components(edges: DataFrame, src: str, dst: str, near: str) -> DataFrame:
    """(node, component) as by connected_components, for edges with a column that tells which of them likely lie in one component.

    Edges of the same `near` meet in a task, which unites them in batches of bounded size; a node that several batches know
    by different least nodes links these, and only such least nodes go through the rounds. `near` may be anything: it sets
    how many are left for the rounds, not the result. A value that most edges have is spread over tasks.
    """
    e = edges.select(F.xxhash64(near).alias("near"), F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    known = _cut(_united(e))
    of = _cut(known.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("_other")))
    split = of.where("component <> _other").select("node", F.col("component").alias("_low"))
    of = of.select("node", "component")
    if split.isEmpty():
        return of
    links = known.join(split, "node").where("component <> _low").select("component", "_low")
    least = connected_components(links, "component", "_low").select(F.col("node").alias("component"), F.col("component").alias("_least"))
    return of.join(least, "component", "left").select("node", F.coalesce("_least", "component").alias("component"))
