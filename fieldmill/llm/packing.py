"""Packing of tokenised documents into fixed-length sequences: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common, tokens

#: Documents in a group, on average. Larger groups leave less padding, smaller ones more tasks.
GROUP_DOCS = 4096
MOST_BYTES = 64 << 20
_ENCODERS: dict[int, tuple] = {}


def tokenizer_file(spark: SparkSession, path: str):
    """A tokenizer's JSON, broadcast after a check of its size."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} characters")
    return spark.sparkContext.broadcast(text)


def byte_characters() -> dict[int, str]:
    """Byte -> the character that stands for it in the tokenizer's model: itself if it is visible, else one from 256 on in turn."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def encoder(text: str) -> tuple:
    """(tokenizer, memo of pre-tokens) of a process. Pre-tokens go to the model of the tokenizers library, each distinct one once."""
    key = zlib.crc32(text.encode())
    if key not in _ENCODERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(text)

        model, shown = t.model, byte_characters()

        def as_shown(word: str) -> str:
            """Of visible ASCII and blanks only the blank is shown as another character."""
            if word.isascii() and word.isprintable():
                return word.replace(" ", shown[32])
            return word.encode().decode("latin-1").translate(shown)

        def many(words: list[str]) -> list[bytes]:
            ids, ends = [], [0]
            for w in words:
                ids += [x.id for x in model.tokenize(as_shown(w))]
                ends.append(len(ids))
            data = np.array(ids, "<u4").tobytes()
            return [data[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

        _ENCODERS[key] = t, tokens.Memo(many)
    return _ENCODERS[key]


def document_ids(words: pa.Array, odd: pa.Array, text: str) -> Iterator[np.ndarray]:
    """The ids of each document of a batch. A text that holds a special token's string, or rare code points, goes to the library whole."""
    t, memo = encoder(text)
    return tokens.batch_ids(words, odd, memo, None, lambda x: np.array(t.encode(x, add_special_tokens=False).ids, "<u4"))


class TournamentTree:
    """Bins of one capacity; an inner node holds the largest room below it, so the first bin with enough room is found from the root down."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Puts an item into the first bin that has room; returns the bin and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had, leaf = room[at], at
        room[at] = left = had - size
        while at > 1:
            at //= 2
            larger = max(room[2 * at], room[2 * at + 1])
            if room[at] == larger:
                break
            room[at] = larger
        return leaf - self.leaves, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, each of 1 to capacity; ties keep their order."""
    tree = TournamentTree(max(1, len(sizes)), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        b, had = tree.put(int(sizes[i]))
        bins[i], offsets[i] = b, capacity - had
    return bins, offsets


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
#: The checksum of all ids of a piece's document.
DOC_CRC = ", doc_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, length: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids and end_id, cut into pieces of `length` and a shorter last one. Texts are read as in pack()."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    import public_tokenizers

    file = tokenizer_file(spark, tokenizer_path)
    rows = tokens.with_pretokens(docs, common.text_of(text_col), public_tokenizers.PATTERN, [F.col(id_col).cast("long")], special="<|endoftext|>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(b["_k0"].to_pylist(), document_ids(b["_words"], b["_odd"], file.value)):
                data = np.append(ids, end_id).astype("<u4").tobytes()
                total, whole = len(data) // 4, zlib.crc32(data)
                for start in range(0, total, length):
                    piece = data[4 * start : 4 * (start + length)]
                    for column, x in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None, whole)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "doc_crc32"])

    return rows.mapInArrow(run, PIECE + DOC_CRC)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, group_docs: int = GROUP_DOCS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most `length` tokens; returns a row for each piece.

    A document is its ids and the id 0, so an empty or null text is one token. Pieces of `length` fill a sequence alone;
    the rest is packed first-fit decreasing, in groups of documents that a keyed hash deals out at random: groups are
    independent, so tasks stay small at any input, and a hot source spreads over all of them. All pieces of a document are in
    one group; a very long text brings a few numbers for each `length` tokens there. Equal pieces keep the order of (doc_id,
    start, crc). Repeated rows are packed as often as they occur; null ids are allowed. sequence_id is the group times
    2^32 and the bin. Only the numbers of pieces are shuffled, unless with_ids keeps their ids (little-endian unsigned
    32-bit) for sequences(). An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    groups = max(1, round(docs.count() / group_docs))
    cut = pieces(docs, tokenizer_path, length, id_col, text_col, with_ids=with_ids)
    group: Column = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "doc_crc32"), F.lit(groups))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        pdf["sequence_id"] = (pdf.pop("_group").astype("int64").to_numpy() << 32) + bins
        pdf["offset"] = offsets
        return pdf

    return cut.withColumn("_group", group).drop("doc_crc32").groupBy("_group").applyInPandas(run, PIECE + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids array<int>, n_tokens of pack(with_ids=True): the pieces of a sequence, at most its length, side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(pdf.sort_values("offset")["ids"]), "<u4")
        return pd.DataFrame({"sequence_id": [pdf["sequence_id"].iloc[0]], "ids": [ids.astype("int32")], "n_tokens": [len(ids)]})

    return packed.groupBy("sequence_id").applyInPandas(run, "sequence_id long, ids array<int>, n_tokens long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
