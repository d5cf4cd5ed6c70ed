"""Whitening and exact search against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import topk, whitening
from strata.llm.registry import op12_whitening, op13_topk_search

VECTORS = "vec_id long, embedding array<double>"


def odd_vectors(rng, n=80, d=6):
    rows = [(i, rng.normal(size=d).round(2).tolist()) for i in range(n)]
    rows += [(200, None), (201, [1.0] * (d - 1) + [float("nan")]), (202, [1.0, None] + [0.0] * (d - 2)), (250, [float("inf")] * d), (300, [float("-inf")] + [0.0] * (d - 1))]
    return rows + [(50, rows[3][1]), (400, [0.0] * d), (450, rows[0][1]), (450, rows[0][1]), (None, rows[5][1]), (500, [0.5]), (550, [])]


def kept(rows, scale, offset=0):
    d = max((len(v) for _, v in rows if v is not None), default=0)
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(i, np.r_[np.floor(scale * np.array(v, dtype=float)) + offset, np.zeros(d - len(v))].astype(np.int64)) for i, v in good]


def plain_top(rows, k, asked):
    x, out = kept(rows, 256), []
    for q, v in {(i, tuple(v)) for i, v in x if i is not None and asked(i)}:
        scored = sorted((-int(np.dot(w, v)), i is None, i or 0) for i, w in x if i != q)
        out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def top_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_search_of_odd_vectors(spark):
    rows = odd_vectors(np.random.default_rng(3))
    df = spark.createDataFrame(rows, VECTORS).withColumns({"key": F.lit("x"), "vector": F.lit("y"), "score": F.lit(1), "rank": F.lit(2)}).repartition(4)
    assert top_rows(topk.top_k(df, F.col("key") % 50 == 0)) == plain_top(rows, 5, lambda i: i % 50 == 0)
    few = rows[:3]
    assert top_rows(topk.top_k(spark.createDataFrame(few, VECTORS), F.col("key") >= 0)) == plain_top(few, 5, lambda i: True)
    for none in ([], [(1, None)], [(50, [1.0])]):
        assert topk.top_k(spark.createDataFrame(none, VECTORS), F.col("key") % 50 == 0).count() == 0


def test_search_in_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(700, 5)), 1))]
    monkeypatch.setattr(topk, "GROUP_ROWS", 60)
    monkeypatch.setattr(topk, "TASK_ROWS", 50)
    assert top_rows(topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("key") % 5 == 0)) == plain_top(rows, 5, lambda i: i % 5 == 0)


@pytest.mark.parametrize("size", [1, 10**5, 10**15, 10**18])
def test_huge_entries(spark, size):
    rng = np.random.default_rng(6)
    rows = [(int(i), (v * size).tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))]
    top = float(1 << 52)
    x = [(i, [int(np.floor(min(max(256.0 * c, -top), top))) for c in v]) for i, v in rows]
    ends = (1 << 63) - 1
    want = []
    for q in (0, 50):
        scored = sorted((-min(max(sum(a * b for a, b in zip(v, x[q][1])), -ends), ends), i) for i, v in x if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert top_rows(topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("key") % 50 == 0)) == sorted(want, key=str)


def test_bound_stops_reading():
    """Where few components are large, lists are read to a small depth and most rows are never scored."""
    rng = np.random.default_rng(7)
    rows = np.zeros((8192, 32), dtype=np.int64)
    rows[np.arange(8192), rng.integers(0, 32, 8192)] = (1000 * rng.pareto(1.0, 8192)).astype(np.int64)
    queries = np.zeros((200, 32), dtype=np.int64)
    queries[np.arange(200), rng.integers(0, 32, 200)] = 1 + rng.integers(0, 9, 200)
    queries[::2] *= -1
    queries[np.arange(200), rng.integers(0, 32, 200)] += 5
    places, scores, scored = topk.search(np.arange(8192), rows, np.arange(10**6, 10**6 + 200), queries, 5, list_rows=512)
    every = queries @ rows.T
    want = np.lexsort((np.broadcast_to(np.arange(8192), every.shape), -every))[:, :5]
    assert (places == want).all() and (scores == np.take_along_axis(every, want, axis=1)).all()
    assert scored < 0.2 * every.size


def test_search_query(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert top_rows(op13_topk_search(spark, sf_dir)) == plain_top(rows, 5, lambda i: i % 50 == 0)


def plain_whitening(rows, k=8):
    x = kept(rows, 1024, 100_000)
    keys, m = [i for i, _ in x], np.array([v for _, v in x], dtype=object)
    n, sums = len(m), m.sum(axis=0)
    exact = n * m - sums
    a = (exact / n).astype(float)
    _, single, axes = np.linalg.svd(a, full_matrices=False)
    values, axes = single**2 / n, axes.T
    rank = min(k, int((single > 1e-11 * single[0]).sum()))
    return keys, n, (exact * exact).sum(axis=1), a @ axes[:, :rank] / np.sqrt(values[:rank]), values[:rank] / values.sum()


def check_whitening(got, rows, tolerance=1e-8):
    keys, n, deviation, white, explained = plain_whitening(rows)
    k = white.shape[1]
    table = {(r["vec_id"], r["deviation"], r["component"]): r for r in got}
    assert len(got) == len(keys) * k and {r["n"] for r in got} <= {n}
    assert len({r["identity_error"] for r in got}) <= 1 and all(r["identity_error"] < 1e-9 for r in got)
    signs = {}
    for key, d, w in zip(keys, deviation, white):
        for c in range(k):
            r = table[key, d if d < 1 << 63 else None, c + 1]
            assert r["explained"] == pytest.approx(explained[c], rel=1e-9)
            sign = signs.setdefault(c, np.sign(r["whitened"] * w[c])) if abs(w[c]) > 0.1 else signs.get(c, 0)
            assert not sign or r["whitened"] == pytest.approx(sign * w[c], abs=tolerance)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [r for r in odd_vectors(rng) if r[1] is None or len(r[1]) == 6]
    rows = [(i, v and [c and c * s for c, s in zip(v, (9, 7, 5, 3, 2, 1))]) for i, v in rows]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"key": F.lit("x"), "vector": F.lit("y"), "n": F.lit(1), "component": F.lit(2)}).repartition(4)
    check_whitening(whitening.whiten(df).collect(), rows)


def test_whitening_below_full_rank(spark):
    rng = np.random.default_rng(9)
    base = np.round(rng.normal(size=(60, 3)) * (4, 2, 1) * 64) / 64
    tied = np.hstack([base, base[:, :1] + base[:, 1:2], base[:, :2] * 2, np.full((60, 1), 0.25), base[:, 2:] * -1])
    rows = [(i, v.tolist()) for i, v in enumerate(tied)]
    check_whitening(whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect(), rows)
    few = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4, 7)) * (7, 6, 5, 4, 3, 2, 1))]
    check_whitening(whitening.whiten(spark.createDataFrame(few, VECTORS)).collect(), few)
    for none in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(none, VECTORS)).count() == 0


def test_whitening_of_ill_conditioned_and_huge_rows(spark):
    rng = np.random.default_rng(10)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 5)) * (1e6, 1e4, 1e2, 1, 0.02))]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    check_whitening(got, rows, 1e-5)
    far = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 3)) * (1e11, 1e10, 1e9))]
    got = whitening.whiten(spark.createDataFrame(far, VECTORS)).collect()
    check_whitening(got, far)
    assert any(r["deviation"] is None for r in got)
    over = [(i, [x, float(i)]) for i, x in enumerate([1e300, -1e300, 5.0, 1e30, -2.0])]
    assert whitening.whiten(spark.createDataFrame(over, VECTORS)).count() == 5  # the second is below RANK


def test_factor_of_graded_rows():
    rng = np.random.default_rng(11)
    left, right = np.linalg.qr(rng.normal(size=(400, 8)))[0], np.linalg.qr(rng.normal(size=(8, 8)))[0]
    values = 10.0 ** -np.arange(8)
    a = left * values @ right.T

    def gram(factors):
        y = a
        for r in factors:
            y = whitening._solved(y, r)
        return y.T @ y

    r, passes = whitening.triangular(gram, 400, 8)
    assert passes > 2 and np.allclose(np.linalg.svd(r)[1], values, rtol=1e-7)


def test_whitening_query(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(op12_whitening(spark, sf_dir).collect(), rows)
