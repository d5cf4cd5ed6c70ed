"""Periodic runs against a search over all periods."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from strata.llm import periodic_runs as P


def plain_runs(words):
    """All runs by trying every period."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, n, seen, out = np.array([ids[w] for w in words]), len(words), [], []
    for q in range(1, n // 3 + 1):
        same = np.r_[False, x[:-q] == x[q:], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = e - s + q
            if length < 2 * q:
                continue
            if any(q % p == 0 and a <= s and s + length <= a + m for a, m, p in seen):
                continue
            seen.append((s, length, q))
            if length >= max(24, 3 * q):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_text(rng):
    kind, words = rng.randrange(6), []
    while len(words) < rng.choice([20, 60, 200, 600]):
        if rng.random() < 0.5:
            words += rng.choices("abcd" if kind < 3 else [f"w{i}" for i in range(500)], k=rng.randrange(1, 30))
        else:
            part = rng.choices("ab" if kind % 2 else "abcdefgh", k=rng.randrange(1, 14))
            words += (part * rng.randrange(1, 12))[: rng.randrange(1, 90)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [made_text(rng) for _ in range(400)] + [["a"] * 500, ["a", "b"] * 300, [], ["a"] * 23, ["a"] * 24, list("abcdefgh") * 3, list("abcdefghi") * 3, (list("abcdefghi") * 3)[:-1]]
    # runs within runs: periods of periods, and one that crosses two others
    texts += [((["a"] * 30 + ["b"]) * 5), (list("aab") * 20 + ["c"]) * 4, list("abc") * 20 + list("abd") * 20]
    got = P.runs_of(texts)
    want = [plain_runs(t) for t in texts]
    assert got == want and sum(map(len, want)) > 200
    assert P.runs_of([]) == [] and P.runs_of([[]]) == [[]]
    for t, alone in zip(texts[:40], want):
        assert P.runs_of([t]) == [alone]


def plain_row(doc_id, text):
    words = P.WORD.findall(text or "")
    words = P.planted(doc_id, words)
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark, sf_dir):
    from strata.llm.registry import op11_periodic_runs

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r[0]: tuple(r[1:]) for r in op11_periodic_runs(spark, sf_dir).collect()}
    assert got == {i: plain_row(i, t) for i, t in rows.items() if len((t or "").split()) < 4000} | {i: got[i] for i, t in rows.items() if len((t or "").split()) >= 4000}
    assert sum(v[0] for v in got.values()) > 5


def test_odd_texts(spark):
    long = "x y z " * 200_000
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a " * 60), (5, "a b " * 40), (5, "a b " * 40), (6, "    é " * 30), (7, long), (8, "A a " * 30 + "\u001c x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("runs", "greatest", "key", "n_words", "collapsed", "start"):
        docs = docs.withColumn(c, F.lit(7))
    got = sorted((r[0] is None, r[0] or 0, tuple(r[1:])) for r in P.digests(P.find_runs(docs, rewrite=P.planted)).collect())
    want = sorted((i is None, i or 0, plain_row(i, t) if t is not long else None) for i, t in rows if t is not long)
    assert [g for g in got if g[1] != 7] == want
    assert next(g[2][:5] for g in got if g[1] == 7) == (1, 0, 600_000, 3, 200_000_000)
    assert P.digests(P.find_runs(docs.limit(0))).count() == 0


def test_slices_keep_whole_texts():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 100, "", "c" * 5, "d" * 5]})
    assert [p.num_rows for p in P._slices(batch, 10)] == [2, 1, 3]
