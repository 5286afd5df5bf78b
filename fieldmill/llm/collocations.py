"""Phrase collocation mining: frequent words become numbers, n-grams of them fixed-width keys, and sorted keys are counted by run length."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.llm import common

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"

#: Lower-case A-Z; a tab is a blank; bytes that end a piece become 0xFF, which no UTF-8 text has.
BREAK = b"\xff"
TABLE = bytes(255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
EDGE = re.compile(rb"[ \xff]")

#: Bytes of a text split into words at once, distinct words a task holds, ids in a row of the encoded table, keys sorted at once.
SLICE, HELD_WORDS, ROW_IDS, SORTED_KEYS = 4 << 20, 200_000, 1 << 20, 1 << 21
#: A dictionary of more words or bytes is joined instead of broadcast.
BROADCAST_WORDS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Words of a document that the join encodes in one row.
BLOCK = 1 << 16
#: Bits of the filter for each frequent n-gram, and of the whole filter (32 MB) at most; a full filter prunes less and loses nothing.
BITS_EACH, MOST_BITS = 16, 28
BUCKETS = 256


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text with BREAK between pieces, a slice at a time; no word is cut."""
    flat, at = text.translate(TABLE), 0
    while at < len(flat):
        edge = EDGE.search(flat, at + SLICE)
        end = edge.start() if edge else len(flat)
        yield flat[at:end].replace(BREAK, b" \xff ").split()
        at = end


def _rows(docs: DataFrame, text_col: str, lang_col: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), common.text_of(text_col).cast("binary").alias("text"), *more)


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word (UTF-8 bytes), f: the occurrences of each word; counted within tasks before they are shuffled."""

    def emit(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, of in counts.items():
            of.pop(BREAK, None)
            if of:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of)), pa.array(list(of), pa.binary()), pa.array(of.values(), pa.int64())], names=["lang", "word", "c"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        held = 0
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                for words in words_of(text.as_py()):
                    of = counts.setdefault(lang, Counter())
                    held -= len(of)
                    of.update(words)
                    held += len(of)
                    if held > HELD_WORDS:
                        yield from emit(counts)
                        held = 0
        yield from emit(counts)

    return _rows(docs, text_col, lang_col).mapInArrow(run, "lang string, word binary, c long").groupBy("lang", "word").agg(F.sum("c").alias("f"))


def numbered(frequent: DataFrame) -> DataFrame:
    """frequent with id, from 1 without gaps: words are numbered within buckets of their hash, behind the words of the buckets before."""
    own = frequent.withColumn("_b", F.pmod(F.xxhash64("lang", "word"), F.lit(BUCKETS)).cast("int"))
    sizes = own.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))  # BUCKETS rows
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("lang", "word"))
    return own.join(F.broadcast(before), "_b").select("lang", "word", "f", (F.col("_before") + rank).alias("id"))


def _encode_by_broadcast(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    ids: dict[str, dict[bytes, int]] = {}
    for r in dictionary.select("lang", "word", "id").toLocalIterator():
        ids.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
    shared = rows.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            a = np.concatenate(held) if held else np.zeros(0, "<u4")
            starts = len(a) if last else len(a) - (LONGEST - 1)
            for at in range(0, starts, ROW_IDS):
                part = a[at : at + ROW_IDS + LONGEST - 1]
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()), pa.array([min(ROW_IDS, starts - at)], pa.int32())], names=["ids", "starts"])
            held, n = ([], 0) if last else ([a[starts:]], LONGEST - 1)

        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"]):
                of = shared.value.get(lang)
                if of is None:
                    continue
                for words in words_of(text.as_py()):
                    held.append(np.fromiter(map(of.get, words, [0] * len(words)), "<u4", len(words)))
                    n += len(words)
                    if n > ROW_IDS:
                        yield from emit(False)
                held.append(np.zeros(1, "<u4"))
                n += 1
        yield from emit(True)

    return rows.mapInArrow(run, "ids binary, starts int")


def _encode_by_join(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same for a dictionary of any size: words meet it in a shuffled join and come back by document and block. Rows are written first, so that their numbers stay the same."""
    rows = common.written(rows.withColumn("row", F.monotonically_increasing_id()), "collocation-rows")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, row, text in zip(b["lang"].to_pylist(), b["row"].to_pylist(), b["text"]):
                at = 0
                for words in words_of(text.as_py()):
                    pos = [at + i for i, w in enumerate(words) if w != BREAK]
                    if pos:
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pos)), pa.array([row] * len(pos), pa.int64()), pa.array(pos, pa.int64()), pa.array([w for w in words if w != BREAK], pa.binary())], names=["lang", "row", "pos", "word"])
                    at += len(words)

    found = rows.mapInArrow(explode, "lang string, row long, pos long, word binary").join(dictionary.select("lang", "word", "id"), ["lang", "word"])
    block, within = F.floor(F.col("pos") / BLOCK), F.pmod(F.col("pos"), F.lit(BLOCK)).cast("int")
    # A block's first words also end the n-grams of the block before.
    places = F.when((within < LONGEST - 1) & (block > 0), F.array(F.struct(block.alias("b"), within.alias("p")), F.struct((block - 1).alias("b"), (within + BLOCK).alias("p")))).otherwise(F.array(F.struct(block.alias("b"), within.alias("p"))))
    at = found.select("row", "id", F.explode(places).alias("_at")).select("row", F.col("_at.b").alias("block"), F.col("_at.p").alias("p"), "id")
    lists = at.groupBy("row", "block").agg(F.collect_list(F.struct("p", "id")).alias("_l")).select(F.col("_l.p").alias("p"), F.col("_l.id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, ids in zip(b["p"], b["id"]):
                a = np.zeros(BLOCK + LONGEST - 1, "<u4")
                a[p.values.to_numpy()] = ids.values.to_numpy()
                out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array([BLOCK] * len(out), pa.int32())], names=["ids", "starts"])

    return lists.mapInArrow(run, "ids binary, starts int")


def encode(docs: DataFrame, dictionary: DataFrame, text_col: str = "text", lang_col: str = "lang", broadcast_words: int = BROADCAST_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """ids (little-endian 32-bit numbers; 0 for other words, ends of pieces and of documents), starts: n-grams begin at so many first places, the rest only ends them."""
    rows = _rows(docs, text_col, lang_col)
    n, size = dictionary.agg(F.count("*"), F.coalesce(F.sum(F.length("word") + F.length("lang")), F.lit(0))).first()
    return (_encode_by_broadcast if n <= broadcast_words and size <= broadcast_bytes else _encode_by_join)(rows, dictionary)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of the rows of an array of 32-bit numbers, by least significant digits first; numpy sorts 16-bit digits by counting."""
    order = np.arange(len(keys))
    for column in range(keys.shape[1] - 1, -1, -1):
        for shift in (0, 16):
            digit = (keys[:, column] >> shift).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of sorted keys, and how often each occurs or the sum of its counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)


def _hashes(a: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n numbers from each place on."""
    h = np.zeros(max(0, len(a) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ a[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return h >> shift, (h * np.uint64(0xD6E8FEB86659FD93)) >> shift


def _packed(keys: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(keys, ">u4")
    offsets = np.arange(0, data.nbytes + 1, max(1, 4 * keys.shape[1]), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.Array, n: int) -> np.ndarray:
    whole = np.frombuffer(column.buffers()[2] or b"", ">u4")
    begin = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) // 4 if len(column) else 0
    return whole[begin : begin + len(column) * n].reshape(-1, n).astype(np.uint32)


def _filter(frequent: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The bits of a filter that has each of the n-grams. Bitmaps of 4 KB are made on the executors; the driver gets at most 2^MOST_BITS bits."""
    count = frequent.count()
    bits = min(MOST_BITS, max(16, (BITS_EACH * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _unpacked(b["key"], n)
            h = _hashes(keys.reshape(-1), n)[::n] if len(keys) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(h, bits)).astype(np.int64) + 1)], names=["p"])

    maps = frequent.select("key").mapInArrow(run, "p long").groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in maps.toLocalIterator():
        out[(r["b"] - 1) * 4096 :][:4096] = np.frombuffer(bytes(r["m"]), np.uint8)[: len(out)]
    return out, bits


def count_grams(encoded: DataFrame, n: int, least: int, shorter: DataFrame | None) -> DataFrame:
    """key (n big-endian 32-bit numbers), f: the n-grams that occur `least` times or more.

    An n-gram is looked at only where the two (n-1)-grams in it pass the filter of the frequent ones, which lets all of
    these and few others through. Each task sorts its keys by radix and sends one count for each; ranges of keys are
    sorted by Spark, and equal neighbours summed.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_filter(shorter, n - 1)) if shorter is not None else None

    def keys_of(row: bytes, starts: int) -> np.ndarray:
        a = np.frombuffer(row, "<u4")
        here = max(0, min(starts, len(a) - n + 1))
        ok = np.ones(here, bool)
        for k in range(n):
            ok &= a[k : k + here] > 0
        if shared is not None and here:
            table, bits = shared.value
            one, two = _places(_hashes(a[: here + n - 1], n - 1), bits)
            there = ((table[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8)) & (table[two >> np.uint64(3)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            ok &= there[:here] & there[1 : here + 1]
        at = np.flatnonzero(ok)
        return np.stack([a[at + k] for k in range(n)], axis=1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            keys = np.concatenate(held)
            keys, counts = run_lengths(keys[radix_order(keys)])
            return pa.RecordBatch.from_arrays([_packed(keys), pa.array(counts, pa.int64())], names=["key", "c"])

        for b in batches:
            for row, starts in zip(b["ids"], b["starts"].to_pylist()):
                held.append(keys_of(row.as_py(), starts))
                size += len(held[-1])
                if size >= SORTED_KEYS:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = np.zeros((0, n), np.uint32), np.zeros(0, np.int64)
        for b in batches:
            keys, counts = run_lengths(np.concatenate([last, _unpacked(b["key"], n)]), np.concatenate([total, b["c"].to_numpy()]))
            last, total, keys, counts = keys[-1:], counts[-1:], keys[:-1], counts[:-1]
            yield pa.RecordBatch.from_arrays([_packed(keys[counts >= least]), pa.array(counts[counts >= least], pa.int64())], names=["key", "f"])
        if len(last) and total[0] >= least:
            yield pa.RecordBatch.from_arrays([_packed(last), pa.array(total, pa.int64())], names=["key", "f"])

    dealt = encoded.mapInArrow(deal, "key binary, c long").repartitionByRange("key").sortWithinPartitions("key")
    return dealt.mapInArrow(add, "key binary, f long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, **limits: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to five words that occur `least` times or more.

    A phrase's score is that of its weakest cut into two parts, floor(1000 a n / (l r)) by exact decimals. A phrase
    inside a longer candidate that occurs as often is left out; as a longer one never occurs more often than its parts,
    one word more is enough to look at. Texts are whole and of any length: they are read in slices. A null text is
    empty, a null language `und`; repeated rows count as often as they occur, identifiers are not looked at and other
    columns ignored. Ties go to the higher count, then to the phrase's bytes. No documents give no rows.
    """
    common.arrow_batches(docs.sparkSession)
    counts = common.written(word_counts(docs, text_col, lang_col), "collocation-words")
    dictionary = common.written(numbered(counts.where(F.col("f") >= least)), "collocation-dictionary")
    encoded = common.written(encode(docs, dictionary, text_col, lang_col, **limits), "collocation-ids")

    def number(c: Column) -> Column:
        return F.unhex(F.lpad(F.hex(c), 8, "0"))

    grams, parts = None, [dictionary.select(number(F.col("id")).alias("key"), "f")]
    for n in range(2, LONGEST + 1):
        grams = common.written(count_grams(encoded, n, least, grams), f"collocation-{n}")
        parts.append(grams)
    known = parts[0]
    candidates = parts[1]
    for g in parts[1:]:
        known = known.unionAll(g)
        candidates = candidates if g is parts[1] else candidates.unionAll(g)
    words = F.floor(F.length("key") / 4).cast("int")
    longer = candidates.where(words > 2)
    inner = longer.select(F.explode(F.array(F.expr("substring(key, 1, length(key) - 4)"), F.expr("substring(key, 5)"))).alias("key"), F.col("f").alias("_f"))
    inner = inner.groupBy("key").agg(F.max("_f").alias("_f"))
    kept = candidates.join(inner, "key", "left").where(F.col("_f").isNull() | (F.col("_f") < F.col("f"))).select("key", F.col("f").alias("a"))

    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    langs = dictionary.select(number(F.col("id")).alias("_word"), "lang")
    cuts = kept.withColumn("_w", words).select("key", "a", F.explode(F.expr("sequence(1, _w - 1)")).alias("k"))
    cuts = cuts.select("*", F.expr("substring(key, 1, 4 * k)").alias("_left"), F.expr("substring(key, 4 * k + 1)").alias("_right"), F.expr("substring(key, 1, 4)").alias("_word"))
    left, right = known.select(F.col("key").alias("_left"), F.col("f").alias("l")), known.select(F.col("key").alias("_right"), F.col("f").alias("r"))
    scored = cuts.join(left, "_left").join(right, "_right").join(langs, "_word").join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    scored = scored.withColumn("score", F.expr(f"({wide('1000')} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    weakest = scored.groupBy("key", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_s")).select("key", "lang", "a", "n", "_s.l", "_s.r", "_s.score")
    # Ties of the last rank stay until their phrases are known.
    best = weakest.withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_r") <= top).drop("_r")
    spelt = best.select("key", F.expr("explode(sequence(1, cast(length(key) / 4 as int)))").alias("_i")).withColumn("_word", F.expr("substring(key, 4 * _i - 3, 4)"))
    spelt = spelt.join(dictionary.select(number(F.col("id")).alias("_word"), F.col("word").cast("string").alias("_text")), "_word")
    spelt = spelt.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_text"))), lambda x: x["_text"]), " ").alias("phrase"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelt, "key").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k >= 2),
inner_parts AS (SELECT lang, array_to_string(string_split(phrase, ' ')[1:k - 1], ' ') AS phrase, f FROM c WHERE k > 2
                UNION ALL SELECT lang, array_to_string(string_split(phrase, ' ')[2:k], ' '), f FROM c WHERE k > 2),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = c.lang AND i.phrase = c.phrase AND i.f >= c.f)),
cuts AS (SELECT kept.lang, kept.phrase, kept.f AS a, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS x, array_to_string(string_split(phrase, ' ')[cut + 1:k], ' ') AS y
         FROM kept, range(1, 5) r(cut) WHERE cut < k),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * a * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN n ON n.lang = cuts.lang),
weakest AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest) WHERE rank <= 2000
"""
