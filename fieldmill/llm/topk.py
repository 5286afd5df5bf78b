"""Exact top-k search by inner product with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.llm import common

TOP, EVERY = 5, 50
#: Segments at each resolution, coarse to fine; queries and vectors in a block.
LEVELS = (1, 4, 16)
QUERY_BLOCK, BLOCK = 512, 2048
BLOCKS = "part int, ids binary, vectors binary, width int"


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, scaled so that the inner product of two rows bounds that of the vectors from above.

    Within a segment of length L, q.x = L (mean_q mean_x) + sum of products of the deviations from the means, and by
    Cauchy and Schwarz the latter is at most L dev_q dev_x.
    """
    parts = x.reshape(len(x), segments, -1).astype(np.float64)
    scale = np.sqrt(parts.shape[2])
    return np.concatenate([parts.mean(axis=2) * scale, parts.std(axis=2) * scale], axis=1)


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, top: int) -> list[tuple[int, int, int]]:
    """(query, vector, score): each query's best of a block, ties to the smaller id."""
    width = -(-max(queries.shape[1], vectors.shape[1], 1) // LEVELS[-1]) * LEVELS[-1]
    q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (queries, vectors))
    exact = x, q
    if width * int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) >= 1 << 63:  # scores by Python's integers
        exact = x.astype(object), q.astype(object)
    levels = [(_statistics(q, s), _statistics(x, s)) for s in LEVELS]
    coarse = levels[0][0] @ levels[0][1].T
    slack = 1e-6 * (1 + np.abs(coarse).max(initial=0)) + 1e-9 * width * (1 + np.abs(q).max(initial=0)) * (1 + np.abs(x).max(initial=0))
    out = []
    for i in range(len(q)):
        able = np.flatnonzero(ids != query_ids[i])
        if not len(able):
            continue
        k = min(top, len(able))
        bound = levels[0][0][i] @ levels[0][1][able].T
        seed = able[np.argpartition(-bound, k - 1)[:k]]
        least = float((exact[0][seed] @ exact[1][i]).min())  # k vectors reach it
        for of_q, of_x in levels:
            able = able[of_x[able] @ of_q[i] >= least - slack]
        score = exact[0][able] @ exact[1][i]
        best = sorted(range(len(able)), key=lambda j: (-score[j], ids[able[j]]))[:top] if score.dtype == object else np.lexsort((ids[able], -score))[:top]
        if score.dtype == object and any(abs(score[j]) >= 1 << 63 for j in best):
            raise OverflowError("a score among the best needs more than 64 bits")
        out += [(int(query_ids[i]), int(ids[j]), int(s)) for j, s in zip(able[best], score[best])]
    return out


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """_id, _v: floor(256 x) of each component. Rows with a null id or vector, or with a component that is null or not finite, are left out.
    A finite component of 2^54 or more, which has no 64-bit integer, is an error."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).cast("long").alias("_id"), F.transform(v, lambda x: F.when(F.abs(x.cast("double")) >= float(1 << 54), F.raise_error(F.lit("a component of 2^54 or more")).cast("long")).otherwise(F.floor(x.cast("double") * 256))).alias("_v"))


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    """A row for each of `count` blocks, dealt by a hash of the identifier and vector."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["_v"]))
        a = np.zeros((len(pdf), width), "<i8")
        for i, v in enumerate(pdf["_v"]):
            a[i, : len(v)] = v
        return pd.DataFrame({"part": [pdf["_b"].iloc[0]], "ids": [pdf["_id"].to_numpy("<i8").tobytes()], "vectors": [a.tobytes()], "width": [width]})

    return rows.withColumn("_b", F.pmod(F.xxhash64("_id", "_v"), F.lit(count)).cast("int")).groupBy("_b").applyInPandas(run, BLOCKS)


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `top` highest integer inner products, ties to the smaller vec_id.

    Blocks of queries meet blocks of vectors; within such a pair bounds from segment means and deviations, coarse to
    fine, leave few vectors, whose scores are computed in full. Pairs return `top` rows a query, and their best are
    ranked. A query's own identifier is no candidate for it. Vectors of unequal length are compared as if zeros
    followed; an empty vector scores 0. Repeated vectors are ranked as often as they occur, of queries that share an identifier the least vector counts. Scores are exact; one among the best that needs more than 64 bits is an error.
    Fewer vectors give fewer ranks; an empty table gives an empty result.
    """
    x = integers(vectors, id_col, vector_col)
    q = integers(queries, id_col, vector_col).groupBy("_id").agg(F.min("_v").alias("_v"))
    blocks_q, blocks_x = (max(1, -(-df.count() // n)) for df, n in ((q, query_block), (x, block)))
    left = _blocks(q, blocks_q).select(F.col("part").alias("qpart"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"), F.col("width").alias("qwidth"))
    right = _blocks(x, blocks_x).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))))
    pairs = right.join(left, "qpart").repartition(F.col("qpart"), F.col("part"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                qi, xi = np.frombuffer(r.qids, "<i8"), np.frombuffer(r.ids, "<i8")
                qv, xv = np.frombuffer(r.qvectors, "<i8").reshape(len(qi), r.qwidth), np.frombuffer(r.vectors, "<i8").reshape(len(xi), r.width)
                yield pd.DataFrame(search_block(qv, qi, xv, xi, top), columns=["query_id", "vec_id", "score"]).astype("int64")

    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    common.arrow_batches(spark)
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i])) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
