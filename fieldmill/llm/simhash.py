"""SimHash near-duplicates with multi-index hashing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.llm import common
from fieldmill.operators.components import connected_components

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: Rounds of label spreading over neighbours' links before the balls are searched; labels only spare known links.
LABEL_ROUNDS = 3
#: Segments of a fingerprint. MOST_BITS // SEGMENTS bits may differ in one of them, which bounds the ball's radius.
SEGMENTS, SEGMENT_BITS = 2, 32


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) of each row: a bit is set if it is set in over half of the hashes of the shingles, repeats included."""
    common.arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).cast("binary").alias("_t"))

    def one(text: bytes) -> int:
        w = text.lower().split()
        if not w:
            return 0
        grams = [b" ".join(w)] if len(w) < shingle else map(b" ".join, zip(*(w[i:] for i in range(shingle))))
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8")
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 65536):
            ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(map(one, b["_t"].to_pylist()), pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _segments(df: DataFrame) -> DataFrame:
    """A row for each segment of a fingerprint: its number and value. Fingerprints with different `f` have tables of their own."""
    of = [F.struct((F.col("f") * SEGMENTS + i).alias("seg"), F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND((1 << SEGMENT_BITS) - 1).alias("val")) for i in range(SEGMENTS)]
    return df.withColumn("_x", F.explode(F.array(*of))).select("*", "_x.seg", "_x.val").drop("_x", "f")


def neighbours(rows: DataFrame) -> DataFrame:
    """Pairs (src, dst) of nodes that share a segment, are neighbours there in the order of their fingerprints, and differ in at most MOST_BITS bits. rows: node, f, fp."""
    w = Window.partitionBy("seg", "val").orderBy("fp", "node")
    pairs = _segments(rows).select("node", "fp", F.lag("node").over(w).alias("src"), F.lag("fp").over(w).alias("sfp"))
    pairs = pairs.where((F.bit_count(F.col("sfp").bitwiseXOR(F.col("fp"))) <= MOST_BITS) & (F.col("src") != F.col("node")))
    return pairs.select(F.greatest("src", "node").alias("src"), F.least("src", "node").alias("dst")).distinct()


def ball_matches(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes of different labels that differ in at most MOST_BITS bits: every segment's table is asked for all values
    in the Hamming ball around a segment (the value and its 32 neighbours), and complete distances are verified.
    rows: node, f, fp; labels: node, component (its own number where a node has none). Columns src, dst, slabel, dlabel."""
    labelled = common.cut(rows.join(labels, "node", "left").select("node", "f", "fp", F.coalesce("component", "node").alias("label")))
    table = _segments(labelled)
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(SEGMENT_BITS)])
    probe = table.withColumn("_flip", F.explode(ball)).select(F.col("seg").alias("pseg"), F.col("val").bitwiseXOR(F.col("_flip")).alias("pval"), F.col("fp").alias("pfp"), F.col("node").alias("src"), F.col("label").alias("slabel"))
    on = (F.col("seg") == F.col("pseg")) & (F.col("val") == F.col("pval")) & (F.col("label") != F.col("slabel")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("pfp"))) <= MOST_BITS) & (F.col("node") < F.col("src"))
    return table.join(probe, on).select("src", F.col("node").alias("dst"), "slabel", F.col("label").alias("dlabel"))


def links(fps: DataFrame) -> DataFrame:
    """Links (src, dst) between distinct fingerprints with the same components as all pairs of at most MOST_BITS differing bits.

    Neighbours in a table's entry are linked first. Pairs that those links already connect are not returned again, so a
    dense group gives few links and not all its pairs.
    """
    rows = fps.select(F.col("fp").alias("node"), F.lit(0).alias("f"), "fp")
    near = common.cut(neighbours(rows))
    far = ball_matches(rows, connected_components(near, rounds=LABEL_ROUNDS)).select(F.greatest("slabel", "dlabel").alias("src"), F.least("slabel", "dlabel").alias("dst")).distinct()
    return near.unionByName(common.cut(far))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach) for each row of docs.

    Texts with equal fingerprints are one node. A-Z are lower-cased; words are runs without ASCII white space; a text of
    fewer words than a shingle has its whole word sequence as one; a null, empty or blank text has the fingerprint zero,
    which is linked like any other. A null doc_id is returned with its component, and is that component's identifier
    only if no other row is in it. Repeated rows are kept; an empty table gives an empty result; other columns are not read.
    """
    rows = common.cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = connected_components(links(nodes))
    placed = nodes.join(of, nodes["fp"] == of["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    ids = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    known = placed.join(ids, "part").select("fp", "component_id")
    return rows.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


#: Of similar_documents(): fingerprints of a text's word set, words of a shingle, least share of common shingles.
VIEWS, SIMILAR_WORDS, SIMILARITY = 4, 5, 0.8
#: Counters of the sketch that orders shingles, its shards, and bits of a text's parity map. They steer the work, never what is found.
COUNTER_BITS, COUNTER_SHARDS, PARITY_BITS = 22, 64, 512
#: Identifiers that are broadcast at most; texts of more are found by a shuffle.
BROADCAST_ROWS = 200_000
EPS = 1e-9
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), "<u8"))


def _shingles(w: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles of SIMILAR_WORDS words of a text's lower-cased words."""
    return _hashes([b" ".join(w)] if len(w) < SIMILAR_WORDS else map(b" ".join, zip(*(w[i:] for i in range(SIMILAR_WORDS)))))


_COUNTS = "shard int, part int, counts binary"


def _counters(shards: list[int], part: int, counts: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(shards, pa.int32()), pa.array([part] * len(shards), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in counts], pa.binary())]


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts, as a table. For each row with an identifier and a word: node; fps, VIEWS independent fingerprints
    of its set of lower-cased words; size, the number of its shingles; p0, p1, ..., the parities of the numbers of shingles by
    PARITY_BITS values of a hash; map, the same by as many values as it has shingles (the next power of two), where these are more. And for each task shard, part, counts: its counters of all shingles by the leading bits of their hashes."""
    common.arrow_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), common.text_of(text_col).cast("binary").alias("_t"))
    words = PARITY_BITS // 64
    names = ["node", "fps", "size", *(f"p{i}" for i in range(words)), "map", "shard", "part", "counts"]

    def parities(h: np.ndarray, bits: int) -> np.ndarray:
        return np.bincount(((h * _MIX[0]) >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1

    def views(h: np.ndarray) -> list[int]:
        out = []
        for m in _MIX[:VIEWS]:
            g = (h ^ (h >> np.uint64(31))) * m
            g ^= g >> np.uint64(29)
            ones = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out.append(int(np.packbits(2 * ones > len(g), bitorder="little").view("<i8")[0]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for b in batches:
            texts = [(i, w) for i, t in zip(b["node"].to_pylist(), b["_t"].to_pylist()) if (w := t.lower().split())]
            odd, sizes, maps = np.zeros((len(texts), PARITY_BITS), np.uint8), [], []
            for k, (_, w) in enumerate(texts):
                h = _shingles(w)
                np.add.at(total, (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
                odd[k] = parities(h, PARITY_BITS)
                sizes.append(len(h))
                maps.append(np.packbits(parities(h, 1 << (len(h) - 1).bit_length()).astype(np.uint8)).tobytes() if len(h) > PARITY_BITS else None)
            bits = np.packbits(odd, axis=1).view("<i8")
            fps = pa.array([views(_hashes(w)) for _, w in texts], pa.list_(pa.int64()))
            n = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), fps, pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(words)), pa.array(maps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        n = COUNTER_SHARDS
        none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), *[pa.nulls(n, pa.int64())] * words, pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, *_counters(list(range(n)), TaskContext.get().partitionId(), np.split(total, n))], names=names)

    schema = "node long, fps array<long>, size int, " + ", ".join(f"p{i} long" for i in range(words)) + ", map binary, " + _COUNTS
    return common.written(rows.mapInArrow(run, schema), "profiles")


def shingle_counts(parts: DataFrame) -> np.ndarray:
    """The counters of all tasks of profiles() added up, shard by shard, in two steps."""
    size, each = 1 << COUNTER_BITS, (1 << COUNTER_BITS) // COUNTER_SHARDS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for shard, blob in zip(b["shard"].to_pylist(), b["counts"].to_pylist()):
                held[shard] = held.get(shard, 0) + np.frombuffer(zlib.decompress(blob), np.int64)
        if held:
            yield pa.RecordBatch.from_arrays(_counters(list(held), 0, list(held.values())), names=["shard", "part", "counts"])

    some = parts.repartition("shard", F.pmod("part", F.lit(64))).mapInArrow(add, _COUNTS)
    out = np.zeros(size, np.int64)
    for r in some.repartition(COUNTER_SHARDS, "shard").mapInArrow(add, _COUNTS).toLocalIterator():
        out[r["shard"] * each : (r["shard"] + 1) * each] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """node, g, at, before: each text's first shingles in one order for all texts, rare ones first, with their places.

    Texts with SIMILARITY of n shingles in common share one of the first n - ceil(SIMILARITY n) + 1, whatever the order;
    shingles that no other row has among its first are left out.
    """
    known = docs.sparkSession.sparkContext.broadcast(counts)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), common.text_of(text_col).cast("binary").alias("_t"))

    def first(text: bytes) -> np.ndarray:
        if not (w := text.lower().split()):
            return np.zeros(0, "<i8")
        h = _shingles(w)
        keep = len(h) - int(np.ceil(SIMILARITY * len(h) - EPS)) + 1
        return h[np.lexsort((h, known.value[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))[:keep]].view("<i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b["node"].to_numpy(), b["_t"]
            for i in range(0, len(ids), 50):
                found = [first(t.as_py()) for t in texts[i : i + 50]]
                long = [len(h) for h in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + 50], long)), pa.array(np.concatenate(found)), pa.array(np.concatenate([np.arange(x, dtype="<i4") for x in long]))], names=["node", "g", "at"])

    entries = rows.mapInArrow(run, "node long, g long, at int")
    w = Window.partitionBy("g").orderBy("node")
    beside = entries.select("*", F.lag("node").over(w).alias("before"), F.lead("node").over(w).alias("after"))
    return common.cut(beside.where("before IS NOT NULL OR after IS NOT NULL").select("node", "g", "at", "before"))


def _able(size: Column, unlike: Column) -> Column:
    """Whether sets of `size` elements together, of which at least `unlike` are in one of them only, can have SIMILARITY in common."""
    return (size - unlike) * (1 + SIMILARITY) >= 2 * SIMILARITY * size - EPS


def _unlike(parity: list[str]) -> Column:
    """Bits in which the parities of a and b differ, which is no more than the shingles that one of them has alone."""
    return sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in parity), F.lit(0))


def possible(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (src, dst) that can be similar by the sizes and parities of profiles()."""
    parity = [c for c in known.columns if c.startswith("p")]
    both = pairs.join(known.alias("a"), F.col("src") == F.col("a.node")).join(known.alias("b"), F.col("dst") == F.col("b.node"))
    unlike = F.greatest(_unlike(parity), F.abs(F.col("a.size") - F.col("b.size")))  # a set's shingles beyond the other's number are its own
    return both.where(_able(F.col("a.size") + F.col("b.size"), unlike)).select("src", "dst").distinct()


def prefix_matches(entries: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (src, dst) of nodes of different labels that can have SIMILARITY of their shingles in common, found at the
    first shingle that they share: by their sizes, by its places and by their parities. known: of profiles()."""
    parity = [c for c in known.columns if c.startswith("p")]
    rows = entries.select("node", "g", "at").join(known, "node").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    a, b = rows.alias("a"), rows.alias("b")
    size = F.col("a.size") + F.col("b.size")
    able = (F.least("a.size", "b.size") >= SIMILARITY * F.greatest("a.size", "b.size") - EPS) & (F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) * (1 + SIMILARITY) >= SIMILARITY * size - EPS)
    on = (F.col("a.g") == F.col("b.g")) & (F.col("a.node") > F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & able & _able(size, _unlike(parity))
    return a.join(b, on).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")).distinct()


def alike(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (src, dst) that can be similar by the maps of profiles(), if both have one. They tell what PARITY_BITS parities
    don't of long texts, whose sets take 32 to 64 times the maps' bytes. maps: node, size, map."""
    both = pairs.join(maps.alias("a"), F.col("src") == F.col("a.node")).join(maps.alias("b"), F.col("dst") == F.col("b.node"))

    def able(size: int, x: bytes | None, y: bytes | None) -> bool:
        if x is None or y is None:
            return True
        x, y = sorted((np.unpackbits(np.frombuffer(m, np.uint8)) for m in (x, y)), key=len)
        unlike = int((x ^ np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)).sum())
        return (size - unlike) * (1 + SIMILARITY) >= 2 * SIMILARITY * size - EPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array(map(able, *(b[c].to_pylist() for c in ("size", "x", "y"))), pa.bool_())
            yield pa.RecordBatch.from_arrays([b["src"].filter(mask), b["dst"].filter(mask)], names=["src", "dst"])

    rows = both.select("src", "dst", (F.col("a.size") + F.col("b.size")).alias("size"), F.col("a.map").alias("x"), F.col("b.map").alias("y"))
    return rows.mapInArrow(run, "src long, dst long").distinct()


def verified(pairs: DataFrame, maps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (src, dst) whose texts share at least SIMILARITY of their sets of SIMILAR_WORDS-word shingles. Sets are
    read of pairs only that alike() leaves, as a set goes along with each pair of its text."""
    pairs = common.cut(alike(pairs, maps))
    nodes = common.cut(pairs.select(F.explode(F.array("src", "dst")).alias("_w")).distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), common.text_of(text_col).cast("binary").alias("_t"))
    rows = rows.join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, F.col("_id") == F.col("_w"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_shingles(w).tobytes() if (w := text.lower().split()) else b"" for text in b["_t"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(out, pa.binary())], names=["_id", "_g"])

    grams = rows.mapInArrow(sets, "_id long, _g binary")
    both = pairs.join(grams.select(F.col("_id").alias("src"), F.col("_g").alias("_a")), "src").join(grams.select(F.col("_id").alias("dst"), F.col("_g").alias("_b")), "dst")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = []
            for x, y in zip(b["_a"].to_pylist(), b["_b"].to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common_ = len(np.intersect1d(x, y, assume_unique=True))
                same.append(common_ >= SIMILARITY * (len(x) + len(y) - common_) - EPS)
            mask = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["src"].filter(mask), b["dst"].filter(mask)], names=["src", "dst"])

    return common.cut(both.select("src", "dst", "_a", "_b").mapInArrow(compare, "src long, dst long").distinct())


def fingerprint_pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (src, dst) of rows with identifiers whose fingerprints, those of near_duplicates(), are equal or linked: of equal
    ones each row with the least, of two linked ones the least of either."""
    rows = common.cut(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    star = rows.join(nodes, "fp").select(F.col("doc_id").alias("src"), F.col("least").alias("dst"))
    ends = [nodes.select(F.col("fp").alias(x), F.col("least").alias(f"_{x}")) for x in ("src", "dst")]
    linked = links(nodes).join(ends[0], "src").join(ends[1], "dst").select(F.greatest("_src", "_dst").alias("src"), F.least("_src", "_dst").alias("dst"))
    return star.unionByName(linked).where("src <> dst").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component) of the documents that are linked: at least SIMILARITY of five-word shingles in common.

    Pairs whose SimHash fingerprints are linked, as near_duplicates() links them, pairs that are neighbours by one of VIEWS
    fingerprints of their word sets, or by a shingle of their prefixes, are held against the texts first; their links' labels only spare known links. All pairs of different labels that share a shingle
    of their prefixes follow, which no pair of SIMILARITY can lack, so no link is lost. Null identifiers and texts without
    words take no part; of rows that share an identifier, all stand for it.
    """
    found = profiles(docs, id_col, text_col)
    rows = found.where("node IS NOT NULL")
    known, maps = rows.drop("fps", "map", "shard", "part", "counts"), rows.select("node", "size", "map")
    entries = prefixes(docs, shingle_counts(found.where("node IS NULL").select("shard", "part", "counts")), id_col, text_col)
    beside = entries.where("before <> node").select(F.greatest("before", "node").alias("src"), F.least("before", "node").alias("dst"))
    views = rows.select("node", F.posexplode("fps").alias("f", "fp"))
    first = fingerprint_pairs(docs, id_col, text_col).unionByName(neighbours(views)).unionByName(beside).distinct()
    near = verified(possible(first, known), maps, docs, id_col, text_col)
    far = verified(prefix_matches(entries, connected_components(near, rounds=LABEL_ROUNDS), known), maps, docs, id_col, text_col)
    return connected_components(near.unionByName(far))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of similar documents the one with the least identifier."""
    drop = common.cut(similar_documents(docs, id_col, text_col).where("component < node").select(F.col("node").alias("_drop")))
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, docs[id_col].cast("long") == drop["_drop"], "left_anti")
