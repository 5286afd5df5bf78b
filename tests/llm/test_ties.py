import numpy as np
import pytest

from fieldmill.llm import exact_dedup, topk


def test_one_row_of_a_group_is_kept_whatever_repeats(spark):
    rows = [(1, "a a", "x"), (1, "a  a", "w"), (2, "a a", "v"), (1, "b", "u"), (1, "b", "u"), (None, "c", "t"), (None, "c", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string").repartition(4)
    marks = exact_dedup.mark_copies(docs).collect()
    assert len(marks) == len(rows)
    kept = [r["text_sha256"] for r in marks if r["kept"]]
    assert len(kept) == len(set(kept)) == 3
    for n in (1, 3):
        assert sorted((tuple(r) for r in exact_dedup.deduplicate(docs.repartition(n)).collect()), key=str) == [(1, "a  a", "w"), (1, "b", "u"), (None, "c", "t")]


def test_scores_of_large_components_are_exact(spark):
    big = float(1 << 44)
    rows = [(0, [big, 1.0]), (50, [0.0, 3.0]), (51, [1.0, big]), (52, [0.0, -big]), (53, [2.0, 2.0]), (54, [big, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows}
    score = lambda a, b: sum(p * q for p, q in zip(ints[a], ints[b]))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id = 50")).collect())
    want = sorted(((score(50, i), -i) for i in ints if i != 50), reverse=True)
    assert got == [(50, n, -i, s) for n, (s, i) in enumerate(want, 1)]
    with pytest.raises(Exception, match="more than 64 bits"):
        topk.top_k(df, df.where("vec_id = 0")).collect()
