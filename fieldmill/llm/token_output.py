"""Training-order materialisation of token sequences: a keyed permutation gives every sequence a slot, range partitions hold fixed-stride rows."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common, packing, tokens

#: Tokens of a sequence, bytes of a token, sequences of a shard.
LENGTH, WIDTH, SHARD_ROWS = 1024, 2, 2048
KEY = b"training order"
#: Bytes of payload that a task of the ordered write holds, about.
PART_BYTES = 256 << 20
#: Texts of an Arrow batch at most; what a worker does for each distinct pre-token of a batch is done less often in larger ones.
SPLIT_ROWS = 2 * common.ARROW_ROWS


class Feistel:
    """Keyed permutation of 0 to n - 1: a balanced Feistel network over the next even number of bits, walked until it is back below n."""

    def __init__(self, n: int, key: bytes, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(key + bytes([r])).digest()[:8], "little")) for r in range(rounds)]

    def _once(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> half, x & mask
        if back:
            a, b = b, a
        for k in keys:
            f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        if back:
            a, b = b, a
        return (a << half) | b

    def _walk(self, x: np.ndarray, keys: list[np.uint64], back: bool) -> np.ndarray:
        out = self._once(x.astype(np.uint64), keys, back)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], keys, back)
        return out.astype(np.int64)

    def slots(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def indexes(self, slots: np.ndarray) -> np.ndarray:
        """The inverse of slots()."""
        return self._walk(slots, self.keys[::-1], True)


SHARD = "slot long, byte_offset long, doc_id long, start long, n_tokens long, ids_crc32 long, payload binary, shard long"
SEQUENCE = "part int, row long, doc_id long, start long, n_tokens long, ids_crc32 long, payload binary"


def tokenised(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, width: int = WIDTH) -> DataFrame:
    """Every document's ids and the id 0 in sequences of `length` and a shorter last one, as a table in the shared folder.

    (part, row) number the sequences of a write; as the table is written once, a task that runs again reads the same numbers.
    """
    import public_tokenizers

    spark = docs.sparkSession
    common.arrow_batches(spark, SPLIT_ROWS)
    file = packing.tokenizer_file(spark, tokenizer_path)
    rows = tokens.with_pretokens(docs, common.text_of(text_col), public_tokenizers.PATTERN, [F.col(id_col).cast("long")], special="<|endoftext|>")
    kind = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, ids in zip(b["_k0"].to_pylist(), packing.document_ids(b["_words"], b["_odd"], file.value)):
                if len(ids) and int(ids.max()) >= 1 << (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                data = np.append(ids, 0).astype(kind).tobytes()
                for at in range(0, len(data), width * length):
                    piece = data[at : at + width * length]
                    for column, x in zip(out, (part, row, doc, at // width, len(piece) // width, zlib.crc32(piece), piece)):
                        column.append(x)
                    row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int32(), *[pa.int64()] * 5, pa.binary()])], names=["part", "row", "doc_id", "start", "n_tokens", "ids_crc32", "payload"])

    return common.written(rows.mapInArrow(run, SEQUENCE), "tokens")


def training_order(sequences: DataFrame, key: bytes = KEY, shard_rows: int = SHARD_ROWS, stride: int = LENGTH * WIDTH) -> DataFrame:
    """The sequences of tokenised() with slot, shard and byte_offset, range-partitioned by slot and sorted; payloads are padded with zeros to the stride behind the shuffle.

    A sequence's index is the number of sequences in earlier parts (a count for each part, some bytes a task, is all that
    the driver sees) and its row; the keyed permutation sends the index to its slot. Slots are 0 to N - 1 without gaps;
    sequence s of shard k stands at byte (s - k * shard_rows) * stride of it, so a reader resumes at any slot.
    """
    spark = sequences.sparkSession
    counts = {r["part"]: r["n"] for r in sequences.groupBy("part").agg(F.count("*").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(counts):
        base[part], total = total, total + counts[part]
    known = spark.sparkContext.broadcast((base, total))

    @F.pandas_udf("long")
    def slot(part: pd.Series, row: pd.Series) -> pd.Series:
        first, n = known.value
        return pd.Series(Feistel(n, key).slots(part.map(first).to_numpy(np.int64) + row.to_numpy(np.int64)))

    out = sequences.withColumn("slot", slot("part", "row")).withColumn("shard", F.floor(F.col("slot") / F.lit(shard_rows)))
    out = out.withColumn("byte_offset", (F.col("slot") - F.col("shard") * shard_rows) * stride)
    # Slots are dense, so equal ranges of whole shards are known without sampling.
    shards = max(1, -(-total // shard_rows))
    parts = max(1, min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * stride // PART_BYTES)))
    out = out.drop("part", "row").repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("slot")
    return out.withColumn("payload", F.rpad("payload", stride, F.lit(b"\0")))


def materialise(docs: DataFrame, tokenizer_path: str, key: bytes = KEY, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Every document's tokens in training order: slot, shard, byte_offset, doc_id, start, n_tokens, ids_crc32, payload.

    A null or empty text is the id 0 alone; repeated rows and null ids are kept; an empty table gives an empty result.
    Other columns of docs are not read. payload has length * width bytes in every row.
    """
    sequences = tokenised(docs, tokenizer_path, id_col, text_col, length, width)
    return training_order(sequences, key, shard_rows, length * width)


def write_shards(ordered: DataFrame, path: str) -> None:
    """Writes the rows of training_order(), whose partitions hold whole shards in slot order, as fixed-stride payloads: a folder for each shard, one file in it."""
    ordered.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All rows of write_shards()."""
    return spark.read.schema(SHARD).parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of write_shards() from a slot on, in order; earlier shards are not opened."""
    return read_shards(spark, path).where((F.col("shard") >= slot // shard_rows) & (F.col("slot") >= slot)).orderBy("slot")


def export_bin(ordered: DataFrame, folder: str) -> DataFrame:
    """Writes each shard as a file of payloads side by side to a folder that all executors mount; returns shard, rows, crc32. A file is renamed when whole, so a task may run again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(pdf.sort_values("slot")["payload"])
        k = int(pdf["shard"].iloc[0])
        name = os.path.join(folder, f"shard-{k:08d}.bin")
        with open(own := f"{name}.{os.getpid()}", "wb") as f:
            f.write(data)
        os.replace(own, name)
        return pd.DataFrame({"shard": [k], "rows": [len(pdf)], "crc32": [zlib.crc32(data)]})

    return ordered.select("shard", "slot", "payload").groupBy("shard").applyInPandas(run, "shard long, rows long, crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ordered = materialise(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    path = os.path.join(common.shared_dir(spark), f"shards-{uuid.uuid4().hex}")
    write_shards(ordered, path)
    return read_shards(spark, path)
