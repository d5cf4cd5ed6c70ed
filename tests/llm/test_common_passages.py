"""Benchmark passages that many documents have copied."""

from __future__ import annotations

import random

from strata.llm import decontamination


def test_parts_and_edits_of_a_common_passage_are_found(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"
    item = [word() for _ in range(60)]
    tail = item[22:]
    edited = [word() if i < 11 or i % 5 == 0 else w for i, w in enumerate(item)]
    texts = [" ".join(tail), " ".join(edited), *[" ".join([*(word() for _ in range(5)), *item]) for _ in range(3000)], *[" ".join(word() for _ in range(40)) for _ in range(20)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_leaks(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()}
    assert got[0]["contaminated"] and got[0]["score"] == len(tail) / len(item)
    assert got[1]["contaminated"]
    assert all(got[i]["contaminated"] == (i < 3002) for i in range(2, len(texts)))
