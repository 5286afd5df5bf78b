"""Exact deduplication by a content sort."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common

SPACE = r"[ \t-\r]+"
#: Characters of the normalised text that lead the sort key; the digest of the whole text follows them.
LEAD = 32
MARK = "doc_id long, text_sha256 string, run string, head_id long, edge string, part int, first boolean"


def sorted_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, norm, text_sha256, range-partitioned, and sorted by the normalised texts within each partition.

    Spark samples the splitters and sorts externally. Splitters are a text's first characters, its digest and the
    identifier: they stay short however long the texts are, and a group of copies may spread over partitions. Within a
    partition the whole texts are the sort key, so equal ones stand side by side, smallest identifier first. Rows of one
    identifier and text have one splitter key and so one partition.
    """
    norm = F.regexp_replace(common.text_of(text_col), SPACE, " ")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    split = rows.repartitionByRange(F.substring("norm", 1, LEAD), F.col("text_sha256"), F.col("doc_id").asc_nulls_last())
    return split.sortWithinPartitions(F.col("norm"), F.col("doc_id").asc_nulls_last())


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Marks each row of docs with the copy that stays; returns doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space is made one blank; a null text counts as
    empty. The smallest doc_id stays, null only if a group has no other; of repeated rows with that doc_id one is marked as kept.
    Texts of any length are sorted and compared whole. Neighbours in sorted_content() are compared in full. Only the groups
    with the least and the greatest splitter key of a partition can go on in another one; these edge runs, two for each
    partition at most, are joined by comparing their texts again. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    names = ["doc_id", "text_sha256", "run", "head_id", "edge", "part", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, text, head, n, last = TaskContext.get().partitionId(), None, None, 0, None
        # (splitter key, text, run, head) of the partition's outermost runs.
        least: tuple | None = None
        most: tuple | None = None

        for b in batches:
            ids, heads, runs, firsts = b["doc_id"].to_pylist(), [], [], []
            for doc, this, digest in zip(ids, b["norm"].to_pylist(), b["text_sha256"].to_pylist()):
                firsts.append(this != text or doc != last)
                last = doc
                if this != text:
                    n, text, head = n + 1, this, doc
                    key = (this[:LEAD], digest)
                    if least is None or key < least[0]:
                        least = (key, this, n, doc)
                    if most is None or key > most[0]:
                        most = (key, this, n, doc)
                heads.append(head)
                runs.append(f"{part}:{n}")
            nothing = pa.nulls(len(ids), pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_sha256"], pa.array(runs, pa.string()), pa.array(heads, pa.int64()), nothing, pa.array([part] * len(ids), pa.int32()), pa.array(firsts, pa.bool_())], names=names)
        for which, run in {"least": least, "most": most}.items():
            if run is not None and (which == "least" or run[2] != least[2]):
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([run[1]]), pa.array([f"{part}:{run[2]}"]), pa.array([run[3]], pa.int64()), pa.array([which]), pa.array([part], pa.int32()), pa.nulls(1, pa.bool_())], names=names)

    marked = common.cut(sorted_content(docs, id_col, text_col).mapInArrow(run, MARK))
    rows = marked.where(F.col("edge").isNull()).drop("edge", "part")
    # Edge runs with equal texts are one group; here text_sha256 holds the text itself.
    edges = marked.where(F.col("edge").isNotNull()).groupBy(F.col("text_sha256").alias("_text")).agg(F.min("head_id").alias("_least"), F.min("run").alias("_name"), F.collect_set("run").alias("_runs"))
    joined = edges.where(F.size("_runs") > 1).select(F.explode("_runs").alias("run"), "_least", "_name")
    sizes = rows.groupBy("run").agg(F.count("*").alias("_n"), F.first("head_id").alias("head_id"))
    groups = sizes.join(joined, "run", "left").select("run", "_n", F.coalesce("_name", "run").alias("_group"), F.coalesce("_least", "head_id").alias("keep_id"))
    whole = groups.groupBy("_group").agg(F.sum("_n").alias("group_size"))
    groups = groups.join(whole, "_group").select("run", "keep_id", "group_size")
    out = rows.drop("head_id").join(groups, "run")
    return out.select("doc_id", "keep_id", "group_size", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that share the identifier and the normalised text, the least as JSON.

    Copies are dropped by an anti join on their identifiers and digests, so the rows that stay are not sorted.
    """
    marks = mark_copies(docs, id_col, text_col)
    names = F.col("doc_id").alias("_drop_id"), F.col("text_sha256").alias("_drop_sha")
    dropped = marks.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*names).distinct()
    sha = F.sha2(F.regexp_replace(common.text_of(text_col), SPACE, " ").cast("binary"), 256)
    own = common.fresh(docs.columns, "_sha")
    left = docs.withColumn(own, sha)
    left = left.join(dropped, left[own].eqNullSafe(dropped["_drop_sha"]) & left[id_col].cast("long").eqNullSafe(dropped["_drop_id"]), "left_anti")
    repeated = marks.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).limit(1)
    if repeated.isEmpty():
        return left.drop(own)
    row = F.struct(*docs.columns)
    least = left.groupBy(F.col(id_col).alias("_id"), F.col(own).alias("_of")).agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return least.select("_row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(common.table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
