"""Controls that str.split takes for white space and the vocabulary doesn't."""

from __future__ import annotations

import random

from strata.llm import tokens


def test_controls_keep_their_ids():
    encode = tokens.encoder(tokens.default_path())
    rng = random.Random(4)
    texts = ["a\x1cb c\x1f d", "\x1d", " \x1e\x1e x\x1e", *["".join(rng.choice("ab \n\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　​.1é") for _ in range(40)) for _ in range(300)]]
    for text in texts:
        got = encode.encode(text)
        assert [int.from_bytes(got[i: i + 4], "little") for i in range(0, len(got), 4)] == encode.exact.encode(text, add_special_tokens=False).ids, repr(text)
