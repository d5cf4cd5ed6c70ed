"""Whole windows of long documents meet no others."""

from __future__ import annotations

import random

from strata.llm import packing


def test_only_remainders_are_grouped(spark, monkeypatch):
    rng = random.Random(5)
    words = ["plain", "word", "of", "some", "text", "that", "goes", "on"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (30_000, 5, 0, 9000, 700, 2047, 2048, 4096, 12_000, 1)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, shard_items=4).collect()
    kept = packing.pack_ids(docs, shard_items=4)
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(kept.select(*rows[0].__fields__).collect())]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for pieces in by_doc.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == pieces[0]["doc_tokens"] and sum(r["length"] < packing.WINDOW for r in pieces) <= 1
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW and (len(pieces) == 1 or all(r["length"] < packing.WINDOW for r in pieces))
    sizes = []
    plain = packing._pack_shard
    monkeypatch.setattr(packing, "_pack_shard", lambda window: lambda key, items: (sizes.append((len(items), int(items["length"].max()))), plain(window)(key, items))[1])
    import pandas as pd

    whole = docs.toPandas()
    made = pd.concat(packing._pieces(packing.tokens.default_path(), packing.WINDOW, 3, False)([whole]))
    for shard, items in made[made["shard"] >= 0].groupby("shard"):
        packing._pack_shard(packing.WINDOW)((shard,), items)
    assert sum(n for n, _ in sizes) <= len(texts) and max(m for _, m in sizes) < packing.WINDOW
