"""Quality of documents by a linear-chain conditional random field over their lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common

#: The bounded sample that the model is fitted on: labelled documents, with all their lines, while these are no more together.
SAMPLE_DOCS, SAMPLE_LINES = 3000, 150_000
THRESHOLD, FOLDS = 0.3, 5
#: A line's own features; prev and next line add theirs, and two more say whether there is one.
OWN = 11
WIDTH = 1 + 3 * OWN + 2

# Classes of code points: 1 upper, 2 lower or other letter, 3 digit, 4 blank, 5 mark that ends or parts a sentence, 6 exclamation, 7 bar, 8 any other.
_CLASS = np.full(0x10000, 2, np.uint8)
for _i in range(0x250):
    _c = chr(_i)
    _CLASS[_i] = 1 if _c.isupper() else 2 if _c.isalpha() else 3 if _c.isdigit() else 4 if _c.isspace() else 6 if _c == "!" else 7 if _c == "|" else 5 if _c in ".,;:?'\"-" else 8


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lengths, first line of each text and the end). An empty text is one empty line."""
    lines = [t.split("\n") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int64)
    flat = [x for t in lines for x in t]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = _CLASS[np.minimum(codes, 0xFFFF)]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.zeros((len(flat), 9))
    for k in range(1, 9):
        run = np.concatenate([[0], np.cumsum(kinds == k)])
        counts[:, k] = run[ends] - run[starts]
    words = [x.split() for x in flat]
    n = np.fromiter(map(len, words), np.float64, len(flat))
    again = np.fromiter((sum(map(str.__eq__, w, w[1:])) for w in words), np.float64, len(flat))
    unlike = np.fromiter((len(set(w)) for w in words), np.float64, len(flat))
    one = np.maximum(n, 1)
    letters, shown = np.maximum(counts[:, 1] + counts[:, 2], 1), np.maximum(lengths, 1)
    own = np.stack(
        [np.log1p(lengths) / 8, counts[:, 1] / letters, counts[:, 6] / one, counts[:, 7] / one, counts[:, 8] / one, counts[:, 3] / shown, counts[:, 5] / one, again / one, (n - unlike) / one, counts[:, 1:4].sum(axis=1) / one / 10, np.log1p(n) / 6], axis=1
    )
    own = np.minimum(own, 1.5)
    first, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    first[at[:-1]], last[at[1:] - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([np.ones((len(flat), 1)), own, before, after, first[:, None], last[:, None]], axis=1), lengths, at


@dataclass
class Field:
    """A chain of two states, 0 bad and 1 good: weights give a line's score for 1, moves those of neighbouring states."""

    weights: np.ndarray
    moves: np.ndarray
    #: Slope and offset that turn a document's aggregate into a probability.
    scale: np.ndarray

    def document(self, features: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each document's score: its lines' marginals weighted by length, then scaled by a monotone curve."""
        if len(at) < 2:
            return np.zeros(0)
        weight = lengths + 1.0
        mean = np.add.reduceat(self.marginals(features, at) * weight, at[:-1]) / np.add.reduceat(weight, at[:-1])
        return 1 / (1 + np.exp(-(self.scale[0] * mean + self.scale[1])))

    def posterior(self, unary: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(good) of each line, expected number of each move) of padded documents by forward-backward in log space."""
        docs, steps = unary.shape
        scores = np.stack([np.zeros_like(unary), unary], axis=2)
        forward = np.zeros((docs, steps, 2))
        forward[:, 0] = scores[:, 0]
        for t in range(1, steps):
            x = np.logaddexp(forward[:, t - 1, 0, None] + self.moves[0], forward[:, t - 1, 1, None] + self.moves[1]) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], x, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        backward = np.zeros((docs, steps, 2))
        moved = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            ahead = scores[:, t + 1] + backward[:, t + 1]
            x = np.logaddexp(ahead[:, 0, None] + self.moves[:, 0], ahead[:, 1, None] + self.moves[:, 1])
            backward[:, t] = np.where(mask[:, t + 1, None], x, 0)
            pair = forward[:, t, :, None] + self.moves + ahead[:, None, :] - total[:, None, None]
            moved += np.exp(pair[mask[:, t + 1]]).sum(axis=0)
        return np.where(mask, np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total[:, None], 0)), 0), moved

    def marginals(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(good) of each line."""
        return self.lines(features @ self.weights, at)[0]

    def lines(self, unary: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(P(good) of each line, expected number of each move); documents of about equal numbers of lines are padded together."""
        sizes = np.diff(at)
        out, moved = np.zeros(len(unary)), np.zeros((2, 2))
        order = np.argsort(sizes, kind="stable")
        i = 0
        while i < len(order):
            j = int(np.searchsorted(sizes[order], 1.5 * sizes[order[i]] + 4, side="right"))
            group = order[i:j]
            steps = np.arange(sizes[group].max())
            mask = steps < sizes[group][:, None]
            where = np.where(mask, at[group][:, None] + steps, 0)
            p, m = self.posterior(np.where(mask, unary[where], 0), mask)
            out[where[mask]] = p[mask]
            moved += m
            i = j
        return out, moved


def fit(documents: list[tuple[np.ndarray, int]], steps: int = 120, passes: int = 2, decay: float = 1e-3) -> Field:
    """Fits a field to (features of lines, label) by gradient steps on the likelihood of line labels.

    Lines start with their document's label; after a pass, lines of bad documents that the field takes for good with
    their neighbours' support are relabelled, as a bad document may hold some. No documents, or those of one label, give
    a field that says good.
    """
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)), np.array([6.0, -3.0]))
    if len({y for _, y in documents}) < 2:
        field.weights[0] = 2.0 if not documents or documents[0][1] else -2.0
        return field
    documents = sorted(documents, key=lambda d: len(d[0]))
    at = np.concatenate([[0], np.cumsum([len(f) for f, _ in documents])])
    flat = np.concatenate([f for f, _ in documents])
    y = np.repeat([float(label) for _, label in documents], np.diff(at))
    bad = np.array([label == 0 for _, label in documents])
    of, n = np.repeat(np.arange(len(documents)), np.diff(at)), len(flat)
    inner = np.ones(n, bool)
    inner[at[:-1]] = False  # lines that follow one of their document
    later = np.flatnonzero(inner)
    for k in range(passes):
        first, second, count = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), 0
        goal = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                goal[a, b] = ((y[later - 1] == a) & (y[later] == b)).sum()
        for _ in range(steps):
            p, moved = field.lines(flat @ field.weights, at)
            g = np.concatenate([flat.T @ (y - p), (goal - moved).ravel()]) / n - decay * np.concatenate([field.weights, field.moves.ravel()])
            count += 1
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            step = 0.15 * (first / (1 - 0.9**count)) / (np.sqrt(second / (1 - 0.99**count)) + 1e-8)
            field.weights += step[:WIDTH]
            field.moves += step[WIDTH:].reshape(2, 2)
        if k + 1 < passes:
            p, _ = field.lines(flat @ field.weights, at)
            y[bad[of]] = p[bad[of]] > 0.5
            whole = bad & (np.add.reduceat(y, at[:-1]) == np.diff(at))
            y[whole[of]] = 0
    weight = np.expm1(flat[:, 1] * 8) + 1.0
    p, _ = field.lines(flat @ field.weights, at)
    mean, label = np.add.reduceat(p * weight, at[:-1]) / np.add.reduceat(weight, at[:-1]), (~bad).astype(float)
    share = np.where(bad, bad.mean(), 1 - bad.mean())
    a = np.stack([mean, np.ones_like(mean)], axis=1)
    for _ in range(50):  # Newton's method for a logistic curve in which both labels weigh the same
        q = 1 / (1 + np.exp(-(a @ field.scale)))
        g = a.T @ ((label - q) / share) - 2.0 * field.scale * (1, 0)
        h = (a.T * (q * (1 - q) / share)) @ a + np.diag([2.0, 1e-6])
        field.scale = field.scale + np.clip(np.linalg.solve(h, g), -2, 2)
    return field


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """The field fitted on at most SAMPLE_DOCS labelled documents outside the held-out fold, in the order of their identifiers' hashes, with all
    lines of each; a document whose lines would make more than SAMPLE_LINES together is passed over.

    Labels that are null, or neither 0 nor 1, and rows with a null identifier are not learned from; a repeated label counts once.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    known = labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).groupBy("_id").agg(F.min("_y").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), common.text_of(text_col).alias("_t")).join(F.broadcast(sample), "_id").select("_id", "_y", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            features, _, at = line_features(b["_t"].to_pylist())
            data = [features[s:e].astype("<f4").tobytes() for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b["_id"], b["_y"], pa.array(data, pa.binary())], names=["_id", "_y", "_f"])

    sizes = rows.select("_id", F.size(F.split("_t", "\n")).alias("_n"), F.xxhash64("_id").alias("_o")).collect()
    taken, total = set(), 0
    for r in sorted(sizes, key=lambda r: (r["_o"], r["_id"])):
        if total + r["_n"] <= SAMPLE_LINES:
            taken.add(r["_id"])
            total += r["_n"]
    got = rows.where(F.col("_id").isin(sorted(taken))).mapInArrow(run, "_id long, _y int, _f binary").collect()
    got = sorted({r["_id"]: r for r in got}.values(), key=lambda r: r["_id"])
    return fit([(np.frombuffer(r["_f"], "<f4").reshape(-1, WIDTH).astype(float), r["_y"]) for r in got])


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "_score", predicted_col: str = "_predicted") -> DataFrame:
    """docs with _score (the mean over lines of P(good), weighted by length) and _predicted. A null or empty text is one empty line of length 1."""
    common.arrow_batches(docs.sparkSession)
    own = common.fresh([*docs.columns, score_col, predicted_col], "_t")
    if {score_col.lower(), predicted_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {score_col} or {predicted_col} are there already; name others")
    known = docs.sparkSession.sparkContext.broadcast((field.weights, field.moves, field.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*known.value)
        for b in batches:
            features, lengths, at = line_features(b[own].to_pylist())
            good = model.document(features, lengths, at)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in b.schema.names if c != own), pa.array(np.clip(good, 0, 1))], names=[*(c for c in b.schema.names if c != own), score_col])

    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add(score_col, DoubleType())
    return docs.withColumn(own, common.text_of(text_col)).mapInArrow(run, schema).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, repeated ones too.

    Only texts are inputs of a score. A null doc_id is not held out. An empty table of labels gives the score of a field
    that takes all lines for good; an empty table of documents gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = score(rows, train(docs, labels, id_col, text_col), "doc_id", "text")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
