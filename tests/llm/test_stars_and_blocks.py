"""Large stars and groups, and columns with the join's own names."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from test_text_operators import brute_near, edited, frame, sentence

from strata.llm import ngram_join
from strata.llm.common import attach
from strata.llm.components import components


def test_components_of_stars_and_chains(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 2000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000 + i, 9000) for i in range(1, 300)] + [(rng.randrange(300, 600) + 20_000, rng.randrange(300) + 20_000) for _ in range(400)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e}


def test_group_values_reach_every_row(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id", F.lit(1).alias("salt"))
    got = attach(df, "k", "id", [F.count("*").alias("n"), F.min("id").alias("m")], [F.sum("n").alias("n"), F.min("m").alias("m")])
    assert got.count() == 5000
    assert {tuple(r) for r in got.select("k", "n", "m").distinct().collect()} == {(0, 1667, 0), (1, 1667, 1), (2, 1666, 2)}


def test_parts_of_blocks_match_all_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.95], rng.integers(0, 1 << 60, 3, dtype=np.uint64)])) for _ in range(50)]
    want = ngram_join.linked(sets)
    monkeypatch.setattr(ngram_join, "EXACT_ROWS", 7)
    inside = {(int(a), int(b)) for x, y in ngram_join._matches(sets, np.arange(50), None) for a, b in zip(x, y)}
    assert inside == {(a, b) for a in range(50) for b in range(a + 1, 50) if want[a, b]} and inside
    across = {(int(a), int(b)) for x, y in ngram_join._matches(sets, np.arange(20), np.arange(20, 50)) for a, b in zip(x, y)}
    assert across == {(a, b) for a in range(20) for b in range(20, 50) if want[a, b]}


def test_recall_on_many_links(spark):
    """Pairs of similarity 0.8 and just above, where pruning is hardest: all links are found."""
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        base = sentence(rng, 120)
        texts += [base] + [edited(rng, base, rng.randint(1, 3)) for _ in range(5)]
    want = brute_near(texts)
    assert sum(n for _, n in want.values()) > 400
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    assert sum(got[i] for i in got) == sum(want[t][1] for t in texts) and all(got[i] == want[t][1] for i, t in enumerate(texts))


def test_columns_named_like_the_joins_own(spark):
    df = frame(spark, ["a b c d e f g", "a b c d e f g", "x y z"])
    for name in ("_node", "_id", "_own", "gone_node", "gone_id", "gone_own", "node", "root", "n", "salt"):
        df = df.withColumn(name, F.lit(1))
    kept = ngram_join.keep_one(df.unionByName(df))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2] and kept.columns == df.columns
