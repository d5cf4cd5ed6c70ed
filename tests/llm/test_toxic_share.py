"""Scores mean the same whether the classes are thinned or not."""

from __future__ import annotations

import random

from strata.llm import toxicity


def test_thinned_classes_keep_the_share(spark):
    rng = random.Random(3)
    labels = [int(i % 9 == 0) for i in range(1800)]
    texts = [" ".join([f"v{rng.randrange(200)}" for _ in range(12)] + ["zounds"] * (y and rng.random() < 0.5)) for y in labels]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "doc_id long, toxic int")
    whole, thin = (toxicity.Scorer(toxicity.train(docs, known, None, n)).one("") for n in (2500, 100))
    assert abs(whole - thin) < 0.05 and thin < toxicity.CUT
