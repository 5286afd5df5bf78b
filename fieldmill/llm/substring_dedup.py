"""Substring deduplication over windows of words with a count-min prefilter."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common

WINDOW = 13
#: Words of the gram under which the sketch counts a window: the gram of least hash within the window.
GRAM = 8
#: The sketch: rows of 2^BITS counters, cut into 2^BITS / 2^SHARD_BITS shards. 2^28 counters make 32 MB a row once counts are bits.
BITS, ROWS, SHARD_BITS = 28, 2, 20
#: Windows that the sketch estimates in so many documents are grouped in salted parts.
HOT, SALTS = 1024, 256

_rng = np.random.default_rng(20240229)
_ONE, _TWO = ((_rng.integers(1, 2**63, WINDOW, dtype=np.uint64) << np.uint64(1)) | np.uint64(1) for _ in range(2))
_GRAM = (_rng.integers(1, 2**63, GRAM, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def _mixed(h: np.ndarray, row: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[row % 3]
    return (h ^ (h >> np.uint64(29))) * _MIX[(row + 1) % 3]


def word_hashes(text: Column) -> Column:
    """The 64-bit hash of each word of a text."""
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of a batch side by side, first position of each text and the end)."""
    lists = b["_h"]
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return values, np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _sums(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(h) - len(by) + 1), np.uint64)
    for j, c in enumerate(by):
        out += h[j : j + len(out)] * c
    return out


def windows(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position in the batch, sketch key) of each window that lies within a document."""
    n = max(0, len(h) - WINDOW + 1)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = doc[:n] == doc[WINDOW - 1 :] if n else np.zeros(0, bool)
    grams = _mixed(_sums(h, _GRAM), 0)
    key = grams[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(key, grams[j : j + n], out=key)
    where = np.flatnonzero(inside)
    return doc[where], where, key[where]


def _packed(positions: np.ndarray) -> bytes:
    """Sorted positions of a shard as 16-bit gaps; a gap of 65535 or more is split, 65535 adding nothing but itself."""
    gaps = np.diff(positions, prepend=0)
    many = gaps // 65535
    if not many.any():
        return gaps.astype("<u2").tobytes()
    out = np.full(len(gaps) + int(many.sum()), 65535, "<u2")
    out[np.arange(len(gaps)) + np.cumsum(many)] = gaps % 65535
    return out.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(gaps)[gaps != 65535]


def sketch(rows: DataFrame, bits: int = BITS, hot: int = HOT) -> dict[tuple[int, int], tuple[bytes, bytes]]:
    """(row, shard) -> compressed bits: counters of at least 2, and of at least `hot`.

    Every task sketches its own windows, each gram once for a run of windows in a document, as sorted counters; shards
    add up the tasks' sketches. The merged sketch has a fixed size, whatever the input.
    """
    shard_bits = min(bits, SHARD_BITS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(held)
            held.clear()
            for r in range(ROWS):
                at = np.sort((_mixed(keys, r + 1) >> np.uint64(64 - bits)).astype(np.int64))
                shards = at >> shard_bits
                edges = np.flatnonzero(np.diff(shards, prepend=-1))
                blobs = [_packed(x & ((1 << shard_bits) - 1)) for x in np.split(at, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edges), r), pa.int32()), pa.array(shards[edges], pa.int32()), pa.array(blobs, pa.binary())], names=["row", "shard", "counters"])

        size = 0
        for b in batches:
            doc, _, key = windows(*_flat(b))
            if len(key):
                held.append(key[(np.diff(doc, prepend=-1) != 0) | (np.diff(key, prepend=key[0]) != 0)])
                size += len(held[-1])
                if size > 4_000_000:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << shard_bits, np.int64)
        for data in pdf["counters"]:
            np.add.at(counts, _unpacked(data), 1)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "shard": pdf["shard"].iloc[:1], "repeated": [zlib.compress(np.packbits(counts >= 2).tobytes(), 1)], "hot": [zlib.compress(np.packbits(counts >= hot).tobytes(), 1)]})

    merged = rows.select("_h").mapInArrow(partial, "row int, shard int, counters binary").groupBy("row", "shard").applyInPandas(merge, "row int, shard int, repeated binary, hot binary")
    return {(r["row"], r["shard"]): (bytes(r["repeated"]), bytes(r["hot"])) for r in merged.toLocalIterator()}


class _Lookup:
    """The sketch's bits in a worker."""

    def __init__(self, shards: dict, bits: int):
        self.bits, shard_bits = bits, min(bits, SHARD_BITS)
        size = max(1, (1 << bits) >> 3)
        self.sets = [[np.zeros(size, np.uint8) for _ in range(ROWS)] for _ in range(2)]
        each = max(1, (1 << shard_bits) >> 3)
        for (row, shard), data in shards.items():
            for i in range(2):
                self.sets[i][row][shard * each : (shard + 1) * each] = np.frombuffer(zlib.decompress(data[i]), np.uint8)

    def __call__(self, key: np.ndarray, which: int) -> np.ndarray:
        found = np.ones(len(key), bool)
        for r in range(ROWS):
            at = (_mixed(key, r + 1) >> np.uint64(64 - self.bits)).astype(np.int64)
            found &= (self.sets[which][r][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found


_LOOKUPS: dict[str, _Lookup] = {}


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, hot: int = HOT) -> DataFrame:
    """doc_id, start (word position) of each window whose words also start in a document of smaller doc_id.

    First pass: the sketch. It counts a window under its least gram, which equal windows share, so a count is never too
    small. Second pass: only windows that it estimates in two documents or more go to the exact grouping, by 128 bits of
    their words' hashes. Windows that it estimates in `hot` documents are grouped in SALTS parts by document first, and
    of each part only its least document in a second, small grouping. No window is left out.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_d"), word_hashes(common.text_of(text_col)).alias("_h"))
    known = spark.sparkContext.broadcast(sketch(rows, bits, hot))
    name = uuid.uuid4().hex

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOOKUPS:
            _LOOKUPS.clear()
            _LOOKUPS[name] = _Lookup(known.value, bits)
        seen = _LOOKUPS[name]
        for b in batches:
            h, at = _flat(b)
            doc, where, key = windows(h, at)
            found = seen(key, 0)
            doc, where, key = doc[found], where[found], key[found]
            if len(doc):
                one, two = _sums(h, _ONE)[where], _sums(h, _TWO)[where]
                ids = b["_d"].to_numpy(zero_copy_only=False)[doc]
                salt = np.where(seen(key, 1), 1 + _mixed(ids.astype(np.uint64), 0) % np.uint64(SALTS), 0).astype(np.int16)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one.view(np.int64), two.view(np.int64), salt, ids, (where - at[doc]).astype(np.int32))], names=["_a", "_b", "_s", "_d", "_p"])

    found = rows.mapInArrow(candidates, "_a long, _b long, _s short, _d long, _p int")
    from pyspark.sql import Window

    least = found.withColumn("_m", F.min("_d").over(Window.partitionBy("_a", "_b", "_s")))
    sure = least.where(F.col("_d") > F.col("_m")).select("_d", "_p")
    open_ = least.where((F.col("_s") > 0) & (F.col("_d") == F.col("_m"))).select("_a", "_b", "_d", "_p")
    open_ = open_.withColumn("_m", F.min("_d").over(Window.partitionBy("_a", "_b"))).where(F.col("_d") > F.col("_m")).select("_d", "_p")
    return sure.unionByName(open_).select(F.col("_d").alias("doc_id"), F.col("_p").alias("start"))


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """Removes each word that lies in a window of 13 words which also starts in a document of smaller doc_id.

    Words are maximal runs without ASCII white space, unchanged; windows are judged on the input. Returns a row for each
    row of docs: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by blanks; null unless
    with_text). A null, empty or blank text has no words. Windows that occur again in the same document only, or in
    rows that share its doc_id, stay. A row with a null doc_id keeps its words and removes no others'. An empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    starts = repeated_starts(docs, id_col, text_col, bits, hot).groupBy("doc_id").agg(F.collect_set("start").alias("_starts"))
    rows = docs.select(F.col(id_col).cast("long").alias("_d"), common.text_of(text_col).cast("binary").alias("_t"))
    joined = rows.join(starts, rows["_d"] == starts["doc_id"], "left").select("_d", "_t", "_starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            lists = b["_starts"]
            for i, text in enumerate(b["_t"].to_pylist()):
                words = text.split()
                n, removed = len(words), 0
                if lists[i].is_valid:
                    edges = np.zeros(n + 1, np.int64)
                    s = lists[i].values.to_numpy()
                    np.add.at(edges, s, 1)
                    np.add.at(edges, s + WINDOW, -1)
                    gone = np.cumsum(edges)[:n] > 0
                    removed = int(gone.sum())
                    words = [w for w, x in zip(words, gone.tolist()) if not x]
                kept = b" ".join(words)
                for column, x in zip(out, (n, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b["_d"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return joined.mapInArrow(run, OUT)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), with_text=False).drop("kept")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, p, sha256(array_to_string(ws[p : p + 12], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
c AS (SELECT DISTINCT doc_id, p + unnest(range(0, 13)) AS p FROM (SELECT k.doc_id, k.p FROM k JOIN m ON k.h = m.h WHERE m.least < k.doc_id)),
g AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
o AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
x AS (SELECT doc_id, ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)) AS stay FROM o)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(stay) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(stay, lambda i: ws[i]), ' '), '')) AS kept_sha256 FROM x
"""
