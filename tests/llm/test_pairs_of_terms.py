"""Interactions of terms that tell nothing alone."""

from __future__ import annotations

import random

import numpy as np

from strata.llm import toxicity


def either(rng, n):
    texts, labels = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"word{rng.randrange(400)}" for _ in range(rng.randint(20, 60))] + ["zounds"] * a + ["folk"] * b
        rng.shuffle(w)
        texts.append(" ".join(w)), labels.append(int(a != b))
    return texts, labels


def test_machine_learns_exclusive_terms():
    rng = random.Random(3)
    machine = toxicity.fit(*either(rng, 4000))
    assert len(machine.place) < 40
    texts, labels = either(rng, 1000)
    scores = toxicity.Scorer(machine)(texts)[0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in zip(scores, labels)]) > 0.95


def test_independent_words_stay_out():
    rng = random.Random(4)
    texts, labels = either(rng, 2000)
    assert len(toxicity.fit(texts, [rng.randrange(2) for _ in labels]).place) < 5
