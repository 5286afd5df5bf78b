import numpy as np
import pytest

from fieldmill.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows):
    """(id, exact deviation, whitened, explained) for each usable row, by one eigendecomposition in memory."""
    usable = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in usable), default=0)
    x = [[int(np.floor(64 * c)) + 1000000 for c in v + [0.0] * (width - len(v))] for _, v in usable]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    out = []
    for (i, _), v in zip(usable, x):
        c = np.array([(n * a - s) / n for a, s in zip(v, sums)])
        out.append((i, sum((n * a - s) ** 2 for a, s in zip(v, sums)), c @ axes[:, order] / np.sqrt(values[order]), values[order] / values.sum()))
    return n, out


def check(df, rows):
    n, want = brute(rows)
    k = len(want[0][2])
    got = [(r["component"], r["vec_id"] is None, r["vec_id"] or 0, int(r["deviation"]), r["whitened"], r["explained"], r["n"], r["identity_error"]) for r in df.collect()]
    assert len(got) == k * len(want) and all(g[6] == n and 0 <= g[7] <= 1e-4 for g in got)
    want = sorted(want, key=lambda w: (w[0] is None, w[0] or 0, w[1]))
    for c in range(k):
        mine = sorted(g for g in got if g[0] == c + 1)
        assert [g[2:4] for g in mine] == [(w[0] or 0, w[1]) for w in want]
        g, w = np.array([g[4] for g in mine]), np.array([w[2][c] for w in want])
        assert np.allclose(g, w * np.sign(g @ w), atol=1e-7, rtol=1e-7)
        assert np.allclose([g[5] for g in mine], want[0][3][c], rtol=1e-9)


def test_registered_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(W.op12_whitening(spark, folder), rows)


def test_copies_nulls_lengths_and_other_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(0, 0.4, 5)]) for i in range(80)]
    rows += [(7, rows[3][1])] * 90 + [(None, rows[4][1]), (2**60 + 1, rows[5][1][:3])]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan")] * 5), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows + bad], SCHEMA + ", n int, component string, _x double")
    check(W.whiten(df.repartition(3)), rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 * (i % 7)), float(i % 3), float(2**50 * (i % 2))]) for i in range(42)]
    check(W.whiten(spark.createDataFrame(rows, SCHEMA)), rows)
    huge = [(i, [float(2.0**55 * (i % 3)), float(i)]) for i in range(9)]
    out = W.whiten(spark.createDataFrame(huge, SCHEMA)).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in out} == {i: d for i, d, _, _ in brute(huge)[1]}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_nothing_to_fit(spark, rows):
    assert W.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_components_without_variance_are_zero(spark):
    one = W.whiten(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], SCHEMA)).collect()
    assert len(one) == 4 and all(r["whitened"] == 0 and r["explained"] == 0 and r["identity_error"] == 0 and r["deviation"] == "0" for r in one)
    line = W.whiten(spark.createDataFrame([(i, [float(i), float(2 * i), 1.0]) for i in range(10)], SCHEMA)).collect()
    assert {r["component"] for r in line if r["whitened"] != 0} == {1} and max(r["identity_error"] for r in line) < 1e-9
