"""Toxicity by a factorization machine over hashed terms.

A term is a distinct lower-case word of a text; it adds the features of the word
and of its first four, five and six characters, hashed to a fixed number of slots. A text
has a slot or not, however many of its words share it.
A slot has a weight and factors if the classes of the sample differ, beyond chance, in
how often it occurs or in how often it occurs together with another slot (their
covariance, so that two slots count as a pair even if neither tells anything alone).
All others have none: a long text has thousands of them, and their noise would add up.
The score is a logistic function of a bias, the features' weights, and all pairwise
interactions <v_i, v_j> of term features, so two terms that are harmless alone can
count together.
The machine is fitted by AdaGrad on a bounded sample of labelled rows (the bound
and the longest sampled text are parameters). Its bias is then set back by the ratio of
the classes' sampling rates, so that scores mean the same at every size, and every
whole text is scored. A worker keeps the summed weight and factors of each word it has met.

Defined results: null and empty texts get the score of the bias alone; repeated rows
get equal scores; a doc_id with several labels counts as toxic if one is; without
labels of both kinds every score is the share of toxic labels (0 if none); very long
texts are scored whole; ties (a score on the cut) are toxic; an empty table gives no
rows; further columns pass unseen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from strata.llm.common import crc_mod, fresh, per_row, small, whole_text

SLOTS = 1 << 28
FACTORS = 4
#: Standard errors by which a slot's share of documents must differ between the classes.
EVIDENCE = 5.0
#: The same for the difference of two slots' covariance, and by how much their correlation must differ as well, as a class
#: of other length or language shifts nearly all covariances a little. Pairs are looked at of all slots that so many of the
#: sample's rows of a class have, as fewer rows can't show that much.
PAIR_EVIDENCE = 5.0
PAIR_STRENGTH = 0.5
PAIR_ROWS = 25
#: Rows of one class that share this part of their slots are copies, and count once for the evidence; they are found by
#: equal minima of hashes, so many in a band.
COPIES, COPY_BANDS, COPY_MINIMA = 0.5, 8, 3
#: Slots of a block: counts of pairs are products of blocks, each a row of a Spark job.
PAIR_BLOCK = 512
PREFIXES = (4, 5, 6)
#: Labelled rows of each class in the fitted sample, about.
SAMPLE = 2500
#: Longest text, in characters, that the fitted sample takes.
SAMPLE_CHARS = 20_000
EPOCHS = 20
CUT = 0.3
CACHE_WORDS = 200_000

_WORD = re.compile(r"\w+")


@dataclass
class Machine:
    """Row k of ``weight`` and ``factor`` belongs to the slot that ``place`` maps to k; row 0 stands for all others and is zero."""

    bias: float
    place: dict[int, int]
    weight: np.ndarray
    factor: np.ndarray


def slots(word: str) -> list[int]:
    forms = [word, *[f"{word[:n]}*" for n in PREFIXES if len(word) > n]]
    return [zlib.crc32(f.encode()) % SLOTS for f in forms]


def terms(text: str | None) -> list[str]:
    return sorted(set(_WORD.findall((text or "").lower())))


@dataclass
class Pairs:
    """The sample's rows of each class as bits, in blocks of slots, and the slots' shares of the rows."""

    blocks: list[tuple[np.ndarray, np.ndarray]]
    sizes: tuple[int, int]
    shares: np.ndarray
    width: int

    def tasks(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(len(self.blocks)) for j in range(i, len(self.blocks))]

    def _rows(self, block: int, k: int) -> np.ndarray:
        at = block * self.width
        return np.unpackbits(self.blocks[block][k], axis=1, count=min(self.width, self.shares.shape[1] - at)).astype(np.float32)

    def telling(self, i: int, j: int) -> list[int]:
        """The slots of two blocks with a partner whose covariance and correlation with them differ between the classes."""
        gap = spread = bend = 0.0
        for k in (0, 1):
            x, y, n = self._rows(i, k), self._rows(j, k), self.sizes[k]
            a, b = self.shares[k, i * self.width :][: x.shape[1], None], self.shares[k, j * self.width :][None, : y.shape[1]]
            together = x.T @ y / n
            cov = together - a * b
            fourth = (1 - 2 * a) * (1 - 2 * b) * together + (1 - 2 * a) * b * b * a + (1 - 2 * b) * a * a * b + a * a * b * b
            gap = gap + (2 * k - 1) * cov
            spread = spread + np.maximum(fourth - cov * cov, 1 / n) / n
            bend = bend + (2 * k - 1) * cov / np.sqrt(np.maximum(a * (1 - a) * b * (1 - b), 1e-12))
        hit = (np.abs(gap) >= PAIR_EVIDENCE * np.sqrt(spread)) & (np.abs(bend) >= PAIR_STRENGTH)
        if i == j:
            np.fill_diagonal(hit, False)  # a slot is no pair with itself
        return [*(i * self.width + np.flatnonzero(hit.any(axis=1))).tolist(), *(j * self.width + np.flatnonzero(hit.any(axis=0))).tolist()]


def _without_copies(rows: list[np.ndarray], y: np.ndarray) -> list[int]:
    """The rows that are no copy of an earlier one of their class: a copied text is no further evidence for its terms."""
    seeds = np.random.default_rng(1).integers(1, 1 << 62, COPY_BANDS * COPY_MINIMA, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    kept: list[int] = []
    first: dict[tuple, int] = {}
    for i, r in enumerate(rows):
        if len(r):
            h = (r.astype(np.uint64) + np.uint64(1))[:, None] * seeds
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            least = h.min(axis=0).reshape(COPY_BANDS, COPY_MINIMA)
            bands = [(int(y[i]), b, *m) for b, m in enumerate(least.tolist())]
            near = {first[b] for b in bands if b in first}
            if any(2 * len(np.intersect1d(r, rows[k], assume_unique=True)) >= 2 * COPIES / (1 + COPIES) * (len(r) + len(rows[k])) for k in near):
                continue
            for b in bands:
                first.setdefault(b, i)
        kept.append(i)
    return kept


def _here(pairs: Pairs) -> set[int]:
    return {s for i, j in pairs.tasks() for s in pairs.telling(i, j)}


def _telling(rows: list[np.ndarray], y: np.ndarray, counted: Callable[[Pairs], set[int]]) -> dict[int, int]:
    """The slots that tell the classes apart, alone or in pairs, numbered from 1."""
    sizes = np.array([(y == 0).sum(), (y == 1).sum()])
    names, which = np.unique(np.concatenate(rows), return_inverse=True)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    toxic = (y == 1)[of]
    n = np.stack([np.bincount(which[~toxic], minlength=len(names)), np.bincount(which[toxic], minlength=len(names))])
    p, both = n / sizes[:, None], n.sum(axis=0) / sizes.sum()
    z = np.abs(p[1] - p[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / sizes).sum())
    chosen = z >= EVIDENCE
    able = np.flatnonzero(((n >= PAIR_ROWS) & (n <= sizes[:, None] - PAIR_ROWS)).any(axis=0))
    chosen[able[sorted(counted(_packed(which, of, y, p, able)))]] = True
    return {int(s): k for k, s in enumerate(names[chosen], 1)}


def _packed(which: np.ndarray, of: np.ndarray, y: np.ndarray, p: np.ndarray, able: np.ndarray) -> Pairs:
    """The occurrences (slot, row) of the ``able`` slots as bits."""
    column = np.full(p.shape[1], -1, dtype=np.int64)
    column[able] = np.arange(len(able))
    kept = column[which] >= 0
    at, place = of[kept], column[which[kept]]
    order = np.argsort(place, kind="stable")
    at, place = at[order], place[order]
    row = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) - 1
    sizes = (int((y == 0).sum()), int((y == 1).sum()))
    blocks = []
    for lo in range(0, len(able), PAIR_BLOCK):
        mine = slice(*np.searchsorted(place, [lo, lo + PAIR_BLOCK]))
        both = []
        for k in (0, 1):
            x = np.zeros((sizes[k], min(PAIR_BLOCK, len(able) - lo)), dtype=bool)
            own = y[at[mine]] == k
            x[row[at[mine][own]], place[mine][own] - lo] = True
            both.append(np.packbits(x, axis=1))
        blocks.append((both[0], both[1]))
    return Pairs(blocks, sizes, p[:, able].astype(np.float64), PAIR_BLOCK)


def fit(texts: list[str], labels: list[int], seed: int = 7, counted: Callable[[Pairs], set[int]] = _here) -> Machine:
    """AdaGrad on logistic loss; the bias starts from the share of toxic rows, so a text without evidence scores that share."""
    share = float(np.mean(labels)) if labels else 0.0
    if not 0 < share < 1:
        return Machine(float(np.log((share + 1e-9) / (1 - share + 1e-9))), {}, np.zeros(1), np.zeros((1, FACTORS)))
    known: dict[str, list[int]] = {}
    own = [np.unique(np.array([s for w in terms(t) for s in (known.get(w) or known.setdefault(w, slots(w)))], dtype=np.int64)) for t in texts]
    known.clear()
    y = np.asarray(labels)
    once = _without_copies(own, y)
    place = _telling([own[i] for i in once], y[once], counted)
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(len(place) + 1), rng.normal(0, 0.01, (len(place) + 1, FACTORS))
    gw, gv, gb, bias = np.full(len(weight), 1e-6), np.full(factor.shape, 1e-6), 1.0, float(np.log(share / (1 - share)))
    rows = [np.array([k for s in r.tolist() if (k := place.get(s))], dtype=np.int64) for r in own]
    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            at = rows[r]
            v = factor[at]
            total = v.sum(axis=0)
            z = bias + weight[at].sum() + 0.5 * (total @ total - (v * v).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r]
            gb += g * g
            bias -= 0.1 * g / np.sqrt(gb)
            if len(at):
                dw = g + 1e-5 * weight[at]
                dv = g * (total[None, :] - v) + 1e-4 * v
                gw[at] += dw * dw
                gv[at] += dv * dv
                weight[at] -= 0.1 * dw / np.sqrt(gw[at])
                factor[at] -= 0.06 * dv / np.sqrt(gv[at])
    factor[0] = 0
    return Machine(float(bias), place, weight, factor)


class Scorer:
    """Scores texts with the summed rows of their words; words without a known slot cost one look-up."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.words: dict[str, list[int] | None] = {}

    def _add(self, word: str) -> list[int] | None:
        place = self.machine.place
        got = self.words[word] = [k for s in slots(word) if (k := place.get(s))] or None
        return got

    def one(self, text: str | None) -> float:
        words, known = set(_WORD.findall((text or "").lower())), self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        at = list({k for w in words if (got := known[w] if w in known else self._add(w)) for k in got})
        z = self.machine.bias
        if at:
            v = self.machine.factor[at]
            z += self.machine.weight[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def __call__(self, texts: list[str | None]) -> tuple[list[float]]:
        return ([self.one(t) for t in texts],)


def _in_tasks(spark: SparkSession, pairs: Pairs) -> set[int]:
    """The telling slots of all pairs of blocks, counted in Spark tasks over the sample's bits (two per row and slot at most are sent)."""
    todo = pairs.tasks()
    if len(todo) < 3:
        return _here(pairs)
    shared = spark.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, j in zip(b["i"], b["j"]):
                yield pd.DataFrame({"slot": np.array(shared.value.telling(int(i), int(j)), dtype=np.int64)})

    parts = max(1, min(len(todo) // 3, spark.sparkContext.defaultParallelism))
    found = spark.createDataFrame(todo, "i int, j int").repartition(parts).mapInPandas(run, "slot long").distinct()
    return {r["slot"] for r in found.collect()}


def train(documents: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2), sample: int = SAMPLE) -> Machine:
    """Fit on about ``sample`` labelled rows of each class, drawn by a hash of doc_id, never on rows held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if held_out:
        known = known.where(crc_mod("doc_id", held_out[0]) != held_out[1])
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = known.where(" or ".join(f"(toxic = {k} and pmod(xxhash64(doc_id), {1 << 40}L) < {int(min(1.0, sample / n) * (1 << 40))}L)" for k, n in sizes.items()))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(small(chosen, 4 * sample), "doc_id").orderBy(draw, "doc_id", "text").limit(3 * sample).collect()
    machine = fit([r["text"] for r in rows], [r["toxic"] for r in rows], counted=partial(_in_tasks, documents.sparkSession))
    if len({r["toxic"] for r in rows}) == 2:
        # The classes are thinned by different rates; without this the odds would grow by their ratio.
        rate = {k: min(1.0, sample / n) for k, n in sizes.items()}
        machine.bias -= float(np.log(rate[1] / rate[0]))
    return machine


def score(documents: DataFrame, machine: Machine, column: str = "score") -> DataFrame:
    """``documents`` with a score for every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    given, text = whole_text(documents)
    wide = per_row(given, [text], [StructField(column, DoubleType())], lambda: Scorer(shared.value))
    return wide if text == "text" else wide.drop(text)


def detect(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(documents, labels))
    return rows.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def remove_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below the cut, with their own columns."""
    column = fresh(documents, "toxicity")
    return score(documents, train(documents, labels), column).where(F.col(column) < CUT).select(*documents.columns)
