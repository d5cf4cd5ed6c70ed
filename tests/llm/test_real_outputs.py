"""What the operators are for: sequences of ids, and spans."""

from __future__ import annotations

import random

from strata.llm import common, language_id, packing, tokens


def test_sequences_hold_every_id(spark):
    rng = random.Random(5)
    texts = ["", None, *[" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 900))) for _ in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = common.cut(packing.pack_ids(docs, shard_items=16))
    rows = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    encode, got = tokens.encoder(tokens.default_path()).encode, {}
    for r in pieces.orderBy("doc_id", "start").collect():
        part = rows[r["sequence_id"]]["ids"][r["offset"]: r["offset"] + r["length"]]
        got[r["doc_id"]] = got.get(r["doc_id"], b"") + b"".join(i.to_bytes(4, "little") for i in part)
    assert got == {i: encode(t) + packing.END_ID.to_bytes(4, "little") for i, t in enumerate(texts)}
    assert all(len(r["ids"]) == packing.WINDOW and set(r["ids"][r["n_tokens"]:]) <= {packing.PAD_ID} for r in rows.values())
    assert sum(r["n_tokens"] for r in rows.values()) == sum(map(len, got.values())) // 4


def test_spans_are_an_output(spark):
    rng = random.Random(6)
    words = {"en": ["the", "house", "with", "other", "thing"], "de": ["schön", "über", "straße", "möglichkeit", "für"]}
    some = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, some(k, 40), k) for i in range(100) for k in [rng.choice(["en", "de"])]]
    a, b = some("en", 40), some("de", 30)
    rows += [(1000, f"  {a}. {b}!", None), (1001, None, None), (1002, "12", None)]
    got = {r["doc_id"]: r["spans"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 1000").collect()}
    assert [tuple(s) for s in got[1000]] == [(2, 2 + len(a), "en"), (4 + len(a), 4 + len(a) + len(b), "de")]
    assert got[1001] == got[1002] == []
