"""Byte-level BPE encoding and decoding with a two-tier lookup.

A whole pre-token that the vocabulary has is resolved by a minimal perfect hash; any other one is merged by a heap over
linked bytes. The vocabulary (some 50,000 entries, about 1 MB) is the only thing broadcast, and its size is checked.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.llm import common, tokens

#: Largest rank file that is broadcast.
MOST_BYTES = 64 << 20


def _slot(a: int, b: int, shift: int, n: int) -> int:
    x = (a + shift * b) & 0xFFFFFFFFFFFF
    return ((x ^ (x >> 21)) * 0x9E3779B97F4A7C15 >> 24) % n


class PerfectHash:
    """Minimal perfect hash of the keys by hash and displace: each of about n / 3 buckets has a displacement that sends its keys to free slots of n."""

    def __init__(self, keys: list[bytes], built: tuple[list[int], list[int]] | None = None):
        n, self.keys = len(keys), keys
        self.n, self.buckets = n, max(1, n // 3)
        if built:
            self.shift, self.slots = built
            return
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            by.setdefault(h % self.buckets, []).append((i, (h >> 40) & 0xFFFFFFFF, (h >> 80) | 1))
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        free = n - 1
        for bucket, members in sorted(by.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                while self.slots[free] >= 0:
                    free -= 1
                self.shift[bucket], self.slots[free] = -free - 1, members[0][0]
                continue
            shift = 0
            while len(at := {_slot(a, b, shift, n) for _, a, b in members}) < len(members) or any(self.slots[x] >= 0 for x in at):
                shift += 1
            self.shift[bucket] = shift
            for i, a, b in members:
                self.slots[_slot(a, b, shift, n)] = i

    def find(self, key: bytes) -> int:
        """The index of a key, or -1; each lookup compares one key."""
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key)
        shift = self.shift[h % self.buckets]
        i = self.slots[-shift - 1 if shift < 0 else _slot((h >> 40) & 0xFFFFFFFF, (h >> 80) | 1, shift, self.n)]
        return i if self.keys[i] == key else -1


class Codec:
    """Encodes pre-tokens and decodes ids by ranks in the rank-file format (base64 key, blank, rank)."""

    def __init__(self, ranks: bytes, pattern: str, built: tuple[list[int], list[int]] | None = None):
        pairs = [line.split() for line in ranks.splitlines() if line]
        keys = [base64.b64decode(a) for a, _ in pairs]
        self.ids = [int(b) for _, b in pairs]
        self.hash = PerfectHash(keys, built)
        self.rank = dict(zip(keys, self.ids))
        self.bytes_of = dict(zip(self.ids, keys))
        self.pattern = regex.compile(pattern)
        self.memo = tokens.Memo(lambda words: [np.array(self.encode_word(w.encode()), "<u4").tobytes() for w in words])

    def encode_word(self, word: bytes) -> list[int]:
        i = self.hash.find(word)
        return [self.ids[i]] if i >= 0 else self.merge(word)

    def merge(self, word: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equal ones, until none is left. O(n log n) for a word of n bytes."""
        n, rank = len(word), self.rank
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) >= n or len(left) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i], part[j] = left + part[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := rank.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (x, i, size + len(part[k])))
            if (h := before[i]) >= 0 and (x := rank.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (x, h, size + len(part[h])))
        return [rank[p] for p in part if p is not None]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def codec(ranks: bytes, pattern: str, built: tuple[list[int], list[int]] | None = None) -> Codec:
    """One codec for each vocabulary in a process; built: the perfect hash's numbers, if another process has found them."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern, built)
    return _CODECS[key]


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """The rank file and its perfect hash, broadcast after a check of the file's size."""
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} has over {MOST_BYTES} bytes")
    own = codec(data, pattern).hash
    return spark.sparkContext.broadcast((data, own.shift, own.slots))


SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes each whole text and decodes the ids again.

    Returns a row for each row of docs, repeated ones too: doc_id (null stays null), n_tokens, ids (null unless with_ids),
    ids_sha256 of the decimal ids joined by blanks, decoded_sha256 of the decoded bytes. A null text counts as empty: no
    ids, and the hashes of nothing. Special tokens are not known: their strings are ordinary text. Other columns of docs
    are not read. An empty table gives an empty result. Texts of any length go through whole; a pre-token of n bytes
    takes n log n steps.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    known = vocabulary(spark, ranks_path, pattern)
    rows = tokens.with_pretokens(docs, common.text_of(text_col), pattern, [F.col(id_col).cast("long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, *built = known.value
        c = codec(ranks, pattern, tuple(built))
        for b in batches:
            out: list[list] = [[], [], [], []]
            for ids in tokens.batch_ids(b["_words"], b["_odd"], c.memo, c.pattern.findall):
                ids = ids.tolist()
                out[0].append(len(ids))
                out[1].append(ids if with_ids else None)
                out[2].append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                out[3].append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["_k0"], pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, SCHEMA)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.drop("ids")


