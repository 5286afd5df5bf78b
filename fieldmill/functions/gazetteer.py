"""Names of a gazetteer in whole texts, by an automaton over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: UTF-8 bytes of the names in one automaton. A larger gazetteer is dealt into several, and texts pass through them one after the other.
AUTOMATON_BYTES = 16 << 20
FOUND = "start int, stop int, name string"


def plain(text: str) -> str:
    """A-Z lower-cased, nothing else changed, so that places in the text stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def matches(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """start, stop, name of every occurrence between word edges, nested and overlapping ones too: no letter or digit stands before or behind it."""
    low, out = plain(text), []
    for last, name in automaton.iter(low):
        start, stop = last + 1 - len(name), last + 1
        if (start == 0 or not low[start - 1].isalnum()) and (stop == len(low) or not low[stop].isalnum()):
            out.append((start, stop, name))
    return out


def find_names(texts: DataFrame, ident: str, text: str, names: DataFrame, key: str = "key", name: str = "name", most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """ident, key, start, stop (code points) of every name in every text, upper and lower case of A-Z alike.

    Names are distinct strings; the automaton finds strings, and a join gives their keys, so a string of many keys costs
    the search nothing. Null and empty texts and names are left out; names of one automaton are bounded by their bytes,
    whatever the size of the gazetteer.
    """
    spark = texts.sparkSession
    low = F.translate(F.col(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = names.select(F.col(key).alias("key"), low.alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
    strings = known.select("name").distinct()
    size = strings.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    parts = max(1, -(-size // most_bytes))
    rows = texts.select(F.col(ident).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL AND _text <> ''")
    # Identifiers of any type pass through Python untouched.
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, {FOUND}"
    found = spark.createDataFrame([], schema)
    for part in range(parts):
        automaton = ahocorasick.Automaton()
        for r in strings.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).toLocalIterator():
            automaton.add_word(r["name"], r["name"])
        if not len(automaton):
            continue
        automaton.make_automaton()
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, hits = [], []
                for i, t in enumerate(b["_text"]):
                    got = matches(shared.value, t.as_py())
                    at += [i] * len(got)
                    hits += got
                spans = [pa.array([h[k] for h in hits], kind) for k, kind in ((0, pa.int32()), (1, pa.int32()), (2, pa.string()))]
                yield pa.RecordBatch.from_arrays([b["_id"].take(pa.array(at, pa.int32())), *spans], names=["_id", "start", "stop", "name"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found.join(known, "name").select(F.col("_id").alias(ident), "key", "start", "stop")


def named_place(found: DataFrame, ident: str, places: DataFrame, key: str = "key", place: str = "place") -> DataFrame:
    """ident, key, place, places: the longest name of each text (ties: the first, then the least key), the place that all its names lie in (null if they differ), and how many places these are."""
    j = found.join(places.select(F.col(key).alias("_k"), F.col(place).alias("_p")), F.col("key") == F.col("_k"), "left")
    best = F.min(F.struct((F.col("start") - F.col("stop")).alias("n"), "start", "key"))
    one = j.groupBy(ident).agg(best.alias("_b"), F.min("_p").alias("_low"), F.max("_p").alias("_high"), F.count_distinct("_p").alias("places"))
    return one.select(ident, F.col("_b.key").alias("key"), F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("place"), "places")


def without_nested(found: DataFrame, ident: str) -> DataFrame:
    """found without names that lie inside a longer one of the same text. Names that begin earlier and end as late, or begin there and end later, are the only ones that can hold one."""
    w = Window.partitionBy(ident).orderBy("start", F.desc("stop"), "key")
    reach = F.max(F.struct("stop", (-F.col("start")).alias("s"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_r", reach)
    inside = F.coalesce((F.col("_r.stop") > F.col("stop")) | ((F.col("_r.stop") == F.col("stop")) & (-F.col("_r.s") < F.col("start"))), F.lit(False))
    return rows.where(~inside).drop("_r")
