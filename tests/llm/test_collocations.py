import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fieldmill.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, top):
    """Every n-gram in memory, scores by Python integers."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, of in f.items():
        names = [p for p, a in of.items() if len(p) > 1 and a >= least]
        ranked = []
        for p in names:
            if any(len(q) > len(p) and of[q] >= of[p] and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q in names):
                continue
            score, k = min((1000 * of[p] * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -of[p], " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def fixture():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["New", "york", "city", "Éa", "of", "the", "a", "b.", "c,d", "x\ty", "z\nq"], 40)), ["en", "fr", None][i % 3]) for i in range(60)]
    rows += [(100 + i, "One two three four five six. new york", "en") for i in range(9)]
    return rows + [(1, None, "en"), (2, "", None), (3, " \t ", "de"), (None, "...", "de"), (5, "a a a a a a a", "aa"), (5, "a a a a a a a", "aa"), (6, "a" * 5000 + " b", "long")]


def test_equals_brute_force_with_ties_repeats_and_overlaps(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for least, top in ((4, 2000), (2, 7)):
        want = brute(rows, least, top)
        assert len(want) > 7 and got(C.collocations(docs, least=least, top=top)) == want


def test_dictionary_too_large_to_broadcast_is_joined(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(C.collocations(docs, least=4, broadcast_words=3)) == brute(rows, 4, 2000)


def test_slices_rows_and_blocks_cut_no_phrase(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 7)
    assert [w for part in C.words_of("Ab cde, fg hij!klmnopqrstuv w".encode()) for w in part] == b"ab cde \xff fg hij \xff klmnopqrstuv w".split()
    text = " ".join(["p q r s t"] * 300)
    docs = spark.createDataFrame([(1, text, "en"), (2, text, "en")], SCHEMA)
    monkeypatch.setattr(C, "ROW_IDS", 64)
    monkeypatch.setattr(C, "BLOCK", 16)
    want = brute([(1, text, "en"), (2, text, "en")], 50, 2000)
    assert got(C.collocations(docs, least=50)) == want
    assert got(C.collocations(docs, least=50, broadcast_words=0)) == want


def test_empty_table_and_other_columns(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "u v. u v", "en", 1, b"k", 2.0)], SCHEMA + ", id int, key binary, n double")
    assert [tuple(r) for r in C.collocations(docs, least=2).collect()] == [("en", 1, "u v", 2, 2, 2, 4, 2000)]


def test_scores_are_exact_beyond_64_bits(spark):
    wide = "cast({} as decimal(38, 0))"
    a, n, left, right = 3_000_000_000_019, 20_000_000_000_003, 7_000_000_000_003, 3_000_000_000_023
    text = f"({wide.format(1000)} * {wide.format(a)} * {wide.format(n)}) div ({wide.format(left)} * {wide.format(right)})"
    assert spark.sql(f"select {text}").first()[0] == 1000 * a * n // (left * right)


def test_radix_order_and_run_lengths():
    keys = np.random.default_rng(1).integers(0, 1 << 32, (500, 3), dtype=np.uint32)
    keys[:200, 0] = 9
    keys = np.concatenate([keys, keys[:100]])
    ordered = keys[C.radix_order(keys)]
    assert ordered.tolist() == sorted(keys.tolist())
    distinct, counts = C.run_lengths(ordered)
    assert dict(zip(map(tuple, distinct.tolist()), counts)) == Counter(map(tuple, keys.tolist()))
    assert C._unpacked(C._packed(keys)[3:], 3).tolist() == keys[3:].tolist()


@pytest.mark.parametrize("table", ["documents"])
def test_registered_query_over_the_whole_table(spark, table, monkeypatch):
    docs = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    assert got(C.op11_collocations(spark, "/root/testdata/sf0.001")) == brute(rows, C.LEAST, C.TOP)
    assert got(C.collocations(docs, least=20)) == brute(rows, 20, C.TOP)
