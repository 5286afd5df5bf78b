"""Pre-tokens as columns, and batches of texts as flat arrays of token ids.

The JVM splits a text by the tokenizer's pattern; a worker then looks at each distinct pre-token of an Arrow batch
once and gathers the ids of all pre-tokens with numpy. How a pre-token gets its ids is the caller's matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points outside those whose letter, number and space classes are alike in the Unicode versions of Java 17 and of the tokenizers' libraries.
RARE = re.compile("[^\u0000-\u07ff\u2000-\u2bff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")

#: Distinct pre-tokens that a worker remembers until a new generation begins; those that the new one does not ask for are forgotten with the next.
REMEMBERED = 400_000


def with_pretokens(df: DataFrame, text: Column, pattern: str, keep: list[Column], special: str | None = None) -> DataFrame:
    """keep, with `_words` (pre-tokens by the pattern) or, for texts with the special token's string, `_odd` (the text). The pattern must leave no character out."""
    odd = F.contains(F.col("_text"), F.lit(special)) if special else F.lit(False)
    words = F.regexp_extract_all(F.col("_text"), F.lit("(?U)" + pattern), F.lit(0))
    names = [f"_k{i}" for i in range(len(keep))]
    return (
        df.select(*[c.alias(n) for c, n in zip(keep, names)], text.alias("_text"))
        .withColumn("_is_odd", odd)
        .select(*names, F.when(~F.col("_is_odd"), words).alias("_words"), F.when(F.col("_is_odd"), F.col("_text")).alias("_odd"))
    )


class Memo(dict):
    """Pre-token -> ids as little-endian unsigned 32-bit integers, filled by many(list of words) -> list of such bytes."""

    def __init__(self, many: Callable[[list[str]], list[bytes]]):
        super().__init__()
        self.many, self.older = many, {}

    def of(self, words: list[str]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        out = list(map(self.get, words))
        gaps = []
        for i in [i for i, x in enumerate(out) if x is None]:
            if (x := self.older.get(words[i])) is None:
                gaps.append(i)
            else:
                self[words[i]] = out[i] = x
        if gaps:
            missing = [words[i] for i in gaps]
            for i, w, x in zip(gaps, missing, self.many(missing)):
                self[w] = out[i] = x
        return out


def batch_ids(words: pa.ListArray, odd: pa.Array, memo: Memo, odd_words: Callable[[str], list[str]] | None, odd_ids: Callable[[str], np.ndarray] | None = None) -> Iterator[np.ndarray]:
    """The ids of each text of a batch, in order.

    A text with RARE code points is odd too: the pattern leaves no character out, so its pre-tokens side by side are the text.
    """
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    flat = words.flatten()
    coded = flat.dictionary_encode()
    inverse = coded.indices.to_numpy(zero_copy_only=False)
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    parts = memo.of(distinct)
    rare = np.zeros(len(distinct), bool)
    for i in np.flatnonzero(~pa.compute.string_is_ascii(coded.dictionary).to_numpy(zero_copy_only=False)).tolist():
        rare[i] = RARE.search(distinct[i]) is not None
    rare = np.concatenate([np.zeros(1, np.int64), np.cumsum(rare[inverse]) if len(distinct) else np.zeros(0, np.int64)])
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    starts = np.cumsum(lengths) - lengths
    pool = np.frombuffer(b"".join(parts), "<u4")
    counts = lengths[inverse] if len(parts) else np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    if len(ends):
        ids = pool[np.repeat(starts[inverse] - (ends - counts), counts) + np.arange(ends[-1])]
    else:
        ids = pool
    ends = np.concatenate([np.zeros(1, np.int64), ends])
    sizes = np.fromiter((0 if n is None else n for n in pa.compute.list_value_length(words).to_pylist()), np.int64, len(words))
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    for i, is_odd in enumerate(odd.is_valid().to_pylist()):
        if not is_odd and rare[at[i]] == rare[at[i + 1]]:
            yield ids[ends[at[i]] : ends[at[i + 1]]]
            continue
        text = odd[i].as_py() if is_odd else "".join(words[i].as_py())
        if odd_ids is not None:
            yield odd_ids(text)
        else:
            yield np.frombuffer(b"".join(memo.of(odd_words(text))), "<u4")
