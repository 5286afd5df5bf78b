"""Embedding whitening: the Gram matrix of exactly centred rows, a local eigendecomposition, and a broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Share of the largest eigenvalue at or below which a component counts as without variance.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n vectors fitted; the mean of dimension i is pivot[i] + rest[i] / n, exactly; columns of components are unit eigenvectors by falling eigenvalue."""

    n: int
    pivot: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x minus the mean as doubles, each rounded once, and the exact sums of squares of n x - S."""
        y = x - self.pivot if int(np.abs(x).max(initial=0)) + int(np.abs(self.pivot).max(initial=0)) < 1 << 62 else x.astype(object) - self.pivot.astype(object)
        most = max(1, int(np.abs(y).max(initial=0))) * self.n + int(np.abs(self.rest).max(initial=0))
        t = y * self.n - self.rest if most < 1 << 62 else y.astype(object) * self.n - self.rest.astype(object)
        square = t if most * most * max(1, x.shape[1]) < 1 << 63 else t.astype(object)
        sums = [int(s) for s in (square * square).sum(axis=1)] if x.shape[1] else [0] * len(x)
        c = t / self.n if most < 1 << 53 else np.array([[int(v) / self.n for v in row] for row in t], float).reshape(x.shape)
        return np.asarray(c, float), sums

    def project(self, c: np.ndarray) -> np.ndarray:
        flat = self.eigenvalues <= FLAT * max(self.eigenvalues.max(initial=0), 0)
        return np.where(flat, 0.0, c @ self.components / np.sqrt(np.where(flat, 1, self.eigenvalues)))


def integers(vectors: DataFrame, width: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """_id, _x: floor(64 c) + 1,000,000 for each component c, shorter vectors filled with zeros. Rows with a null vector or a component that is null or not finite are left out."""
    v = F.col(vector_col)
    full = F.concat(F.transform(v, lambda c: c.cast("double")), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(v)))
    x = F.transform(full, lambda c: F.floor(c * SCALE) + SHIFT)
    return vectors.where(_usable(v)).select(F.col(id_col).cast("long").alias("_id"), x.alias("_x"))


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def _array(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, width), np.int64)


def _sums(fit: DataFrame, width: int) -> tuple[int, int, list[int]]:
    """The number of rows, the largest number without sign, each dimension's exact sum; a task sends one row for each dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, most, total = 0, 0, np.zeros(width, object)
        for pdf in batches:
            if len(pdf):
                x = _array(pdf["_x"], width)
                n, most = n + len(x), max(most, abs(int(x.min())), abs(int(x.max())))
                total = total + (x.sum(axis=0) if most * len(x) < 1 << 63 else x.astype(object).sum(axis=0))
        yield pd.DataFrame({"i": range(-2, width), "s": [str(most), str(n), *(str(int(t)) for t in total)]})

    s = F.col("s").cast("decimal(38, 0)")
    rows = fit.mapInPandas(run, "i int, s string").groupBy("i").agg(F.sum(s).alias("s"), F.max(s).alias("m")).collect()  # width + 2 rows
    of = {r["i"]: int(r["m"] if r["i"] == -2 else r["s"]) for r in rows}
    return of.get(-1, 0), of.get(-2, 0), [of.get(i, 0) for i in range(width)]


def _identity_error(fit: DataFrame, w: Whitening, width: int) -> float:
    """The largest entry, without sign, of the whitened fit list's covariance minus the identity; a task sends k^2 + k sums."""
    k = w.components.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k))
        for pdf in batches:
            if len(pdf):
                y = shared.value.project(shared.value.centred(_array(pdf["_x"], width))[0])
                total += np.vstack([y.T @ y, y.sum(axis=0)])
        yield pd.DataFrame({"i": np.repeat(np.arange(k + 1), k), "j": np.tile(np.arange(k), k + 1), "s": total.reshape(-1)})

    out = np.zeros((k + 1, k))
    for r in fit.mapInPandas(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    mean = out[k] / w.n
    off = np.abs(out[:k] / w.n - np.outer(mean, mean) - np.eye(k))
    varied = w.eigenvalues > FLAT * w.eigenvalues.max(initial=0)
    return float(off[varied][:, varied].max(initial=0.0))


def fit_whitening(x: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors _x of x; None if there are none or they have no dimension.

    Sums are exact integers. Each row is centred as an integer (n x - S) before it becomes a double, so the common
    offset of a million cancels without rounding; MLlib adds up the outer products of the centred rows, and the driver
    decomposes one matrix of width x width.
    """
    if not width:
        return None
    spark = x.sparkSession
    fit = common.written(x.select("_x").distinct(), "whitening-fit")
    n, most, sums = _sums(fit, width)
    if not n:
        return None
    pivot, rest = [s // n for s in sums], [s % n for s in sums]
    pairs = F.arrays_zip(F.col("_x").alias("x"), F.lit(pivot).alias("p"), F.lit(rest).alias("r"))
    exact = "long" if 2 * (most + 1) * n < 1 << 62 else "decimal(20, 0)"
    centred = F.transform(pairs, lambda z: ((z["x"].cast(exact) - z["p"].cast(exact)) * F.lit(n).cast(exact) - z["r"].cast(exact)).cast("double") / float(n))
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("row")), "row")
    gram = RowMatrix(rows, numRows=n, numCols=width).computeGramianMatrix().toArray() / n
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    top = np.argsort(-values, kind="stable")[: min(components, width)]
    w = Whitening(n, np.array(pivot, np.int64), np.array(rest, np.int64), axes[:, top], values[top], float(np.trace(gram)))
    return Whitening(w.n, w.pivot, w.rest, w.components, w.eigenvalues, w.trace, _identity_error(fit, w, width))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (exact, as decimal digits), whitened, explained, identity_error for each usable row and component.

    Fitted on each distinct vector of integers once, so copies weigh nothing; applied to every row. Null vectors and
    ones with a null, infinite or undefined entry are left out; a null identifier stays null; repeated rows are
    returned as often as they occur, other columns ignored. A vector shorter than the longest is filled with zeros.
    A component without variance (one vector, or fewer independent ones than components) is 0 everywhere, explains 0
    and is left out of identity_error. A component whose integer needs more than 64 bits is an error. Equal eigenvalues come in the order of the decomposition. An empty table, or
    vectors without entries, give an empty result.
    """
    common.arrow_batches(vectors.sparkSession, 10_000)
    spark = vectors.sparkSession
    width = vectors.where(_usable(F.col(vector_col))).agg(F.max(F.size(vector_col))).first()[0] or 0
    x = integers(vectors, width, id_col, vector_col)
    w = fit_whitening(x, width, components)
    if w is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double")
    shared = spark.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                centred, sums = shared.value.centred(_array(pdf["_x"], width))
                yield pd.DataFrame({"_id": pdf["_id"], "_none": pdf["_none"], "_d": list(map(str, sums)), "_y": list(shared.value.project(centred))})

    rows = x.select(F.coalesce("_id", F.lit(0)).alias("_id"), F.col("_id").isNull().alias("_none"), "_x")
    done = rows.mapInPandas(run, "_id long, _none boolean, _d string, _y array<double>")
    done = done.select(F.when(~F.col("_none"), F.col("_id")).alias("vec_id"), F.col("_d").alias("deviation"), F.posexplode("_y").alias("_i", "whitened"))
    flat = w.eigenvalues <= FLAT * max(w.eigenvalues.max(initial=0), 0)
    explained = F.lit([0.0 if z else float(e / w.trace) for e, z in zip(w.eigenvalues, flat)])
    return done.select("vec_id", (F.col("_i") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("_i")].alias("explained"), F.lit(w.identity_error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As whiten(); a deviation that needs more than 64 bits is null."""
    return whiten(common.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))
