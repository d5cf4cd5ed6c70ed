"""Spans that the tagger adds, base spans against their patterns, and long runs."""

from __future__ import annotations

import random
import re
import time

import numpy as np
from test_text_operators import frame, numbered_text

from strata.llm import pii

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k in pii.KINDS:
        for m in re.finditer(FORMS[k], text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}
            if fits[k]:
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_equal_their_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("ab1290.@+-% ()é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_their_length():
    begun = time.time()
    for run in ("1" * 300_000 + ".1.1.1", "a" * 300_000, "@" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "1 " * 150_000):
        assert len(pii.base_spans(run)) <= len(run) // 8
    assert time.time() - begun < 20
    assert pii.base_spans("x " + "0" * 5000 + "1.1.1.1 " + "9" * 5000 + ".1.1.1") == [("ip", 2, 5009)]


def test_rewritten_forms_are_added(spark):
    rng = random.Random(2)
    tagger = pii.train(*pii.training_windows([numbered_text(rng) for _ in range(400)]))
    draw = np.random.default_rng(8)
    made = [pii.labelled(numbered_text(rng), draw, 1.0) for _ in range(80)]
    texts = [t for t, _ in made]
    found = pii.added_spans(texts, [[] for _ in texts], tagger)
    got, want = ({(i, s) for i, x in enumerate(all_) for s in x} for all_ in (found, [s for _, s in made]))
    assert len(got & want) > 0.85 * len(want) and len(got & want) > 0.9 * len(got)
    assert all(t[a:b] for t, spans in made for _, a, b in spans)


def test_query_adds_spans_that_no_pattern_takes(spark):
    rng = random.Random(3)
    wrong = "4111111111111112"
    texts = [numbered_text(rng) for _ in range(300)] + [f"pay with {wrong} now"] * 2
    rows = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    assert rows[300]["n_added"] == 1 and rows[300]["n_card"] == 0 and rows[300]["spans"] == rows[301]["spans"] == "card:9:25"
    assert pii.redact(frame(spark, texts)).where("doc_id = 300").first()["text"] == "pay with [CARD] now"
