"""Pairs of terms are found among many common words, and where they are rare."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strata.llm import toxicity


def texts(rng, n, share, fillers, filler_share):
    """Two words that occur together in toxic texts and apart in clean ones, each in the same share of both."""
    out, labels = [], []
    for i in range(n):
        y = i % 2
        w = [f"filler{k}" for k in range(fillers) if rng.random() < filler_share]
        w += (["zounds", "folk"] if y else [rng.choice(["zounds", "folk"])]) if rng.random() < (share if y else 2 * share) else []
        rng.shuffle(w)
        out.append(" ".join(w)), labels.append(y)
    return out, labels


@pytest.mark.parametrize("share,fillers,filler_share", [(0.2, 50, 0.35), (0.2, 700, 0.35), (0.015, 50, 0.35)])
def test_pairs_are_learned(share, fillers, filler_share):
    rng = random.Random(9)
    machine = toxicity.fit(*texts(rng, 5000, share, fillers, filler_share))
    assert {toxicity.slots(w)[0] for w in ("zounds", "folk")} <= set(machine.place) and len(machine.place) < 40
    scorer = toxicity.Scorer(machine)
    fill = [" ".join(f"filler{k}" for k in range(fillers) if rng.random() < filler_share) for _ in range(50)]
    mean = lambda words: np.mean(scorer([f"{t} {words}" for t in fill])[0])
    assert mean("zounds folk") > 0.9 and mean("zounds") < 0.2 and mean("folk") < 0.2


def test_blocks_in_tasks_equal_blocks_here(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 16)
    rng = random.Random(10)
    docs, labels = texts(rng, 1200, 0.2, 60, 0.3)
    here = toxicity.fit(docs, labels)
    there = toxicity.fit(docs, labels, counted=lambda p: toxicity._in_tasks(spark, p))
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", 512)
    assert here.place == there.place == toxicity.fit(docs, labels).place and here.place
