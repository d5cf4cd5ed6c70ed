"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Test items give word n-grams. A first pass over the corpus counts in how many
documents each occurs; an item's seeds are its n-grams that are rare there, those of
passages that are common as a whole, and its rarest ones in any case. A second pass joins documents to items by the
seeds and aligns the item with the words around the hits by Smith-Waterman, so
copies with replaced, dropped or added words still score. The items are a stated
query set: they are handed to all tasks in blocks of a bounded number of n-grams,
and a further block means a further pass, never a dropped item.

Defined results: null and empty texts and items match nothing; items shorter than an
n-gram use one n-gram of all their words; repeated rows get equal result rows; ties
take the least item_id; an empty table of either kind gives no matches; further
columns pass unseen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from strata.llm.common import fresh, map_slices, per_row, whole_text

SEED_WORDS = 4
#: A seed is rare if at most this share of the documents has it, or this many.
RARE_SHARE = 0.0005
RARE_DOCS = 20
#: Seeds that every item keeps, the rarest first, even if none is rare.
LEAST_SEEDS = 8
#: Common seeds in a row from which they are a copied passage and all kept.
COMMON_RUN = 4
#: n-grams of items held by a task at once.
BLOCK_SEEDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score over that of a whole exact copy, from which a document is contaminated.
THRESHOLD = 0.5

_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Items:
    """A block of items: vocabulary, word ids of each, and the sorted seed hashes with their places."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    seeds: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    sizes: tuple[int, ...]


def _hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n known words; runs with an unknown word (0) get 0."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    known = np.ones(len(out), dtype=bool)
    for i in range(n):
        part = words[i: len(words) - n + 1 + i].astype(np.uint64)
        out = (out ^ part) * _MIX
        out ^= out >> np.uint64(31)
        known &= part > 0
    return np.where(known, out | np.uint64(1), np.uint64(0))


def block_of(items: list[tuple[int, str]]) -> Items:
    vocabulary: dict[str, int] = {}
    ids, words = [], []
    for item_id, text in items:
        w = _WORD.findall((text or "").lower())
        if w:
            ids.append(item_id)
            words.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], dtype=np.int64))
    seeds, owner, place, sizes = [], [], [], set()
    for k, w in enumerate(words):
        n = min(SEED_WORDS, len(w))
        sizes.add(n)
        h = _hashes(w, n)
        seeds.append(h), owner.append(np.full(len(h), k)), place.append(np.arange(len(h)))
    if not seeds:
        return Items([], [], {}, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), ())
    s, o, p = np.concatenate(seeds), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(s, kind="stable")
    return Items(ids, words, vocabulary, s[order], o[order], p[order], tuple(sorted(sizes)))


def blocks(benchmark: DataFrame, limit: int = BLOCK_SEEDS) -> Iterator[Items]:
    """The items in blocks of at most ``limit`` n-grams (a longer item is a block of its own)."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        n = len(_WORD.findall(row[1] or ""))
        if held and size + n > limit:
            yield block_of(held)
            held, size = [], 0
        held.append((row[0], row[1]))
        size += n
    if held:
        yield block_of(held)


def _known(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    get = vocabulary.get
    return np.array([get(w, 0) for w in _WORD.findall((text or "").lower())], dtype=np.int64)


def _hits(words: np.ndarray, block: Items) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``words`` and the index of the first equal seed of the block."""
    at, seed = [], []
    for n in block.sizes:
        h = _hashes(words, n)
        some = np.flatnonzero(h)
        if len(some) and len(block.seeds):
            k = np.minimum(np.searchsorted(block.seeds, h[some]), len(block.seeds) - 1)
            good = block.seeds[k] == h[some]
            at.append(some[good]), seed.append(k[good])
    return (np.concatenate(at), np.concatenate(seed)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def document_counts(documents: DataFrame, block: Items) -> np.ndarray:
    """In how many documents each seed of the block occurs; counted in the tasks, summed by one small shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        total = np.zeros(len(items.seeds), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                total[np.unique(_hits(_known(text, items.vocabulary), items)[1])] += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"seed": some, "n": total[some]})

    found = map_slices(documents.select(F.col("text").cast("string").alias("text")), count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    out = np.zeros(len(block.seeds), dtype=np.int64)
    for row in found.toLocalIterator():  # at most one row a seed of this bounded block
        out[row["seed"]] = row["n"]
    first = np.searchsorted(block.seeds, block.seeds)
    return out[first]


def rare(block: Items, counts: np.ndarray, documents: int) -> Items:
    """The block with the rare seeds and the runs of common ones; every item keeps its LEAST_SEEDS rarest.

    A phrase that is common by itself is short. COMMON_RUN common seeds in a row are a
    passage that many documents have copied, so all of them stay: dropping them would
    lose those that hold another part of it, or edited.
    """
    keep = counts <= max(RARE_DOCS, RARE_SHARE * documents)
    by_place = np.lexsort((block.place, block.owner))
    common = ~keep[by_place]
    change = np.flatnonzero(np.diff(common) | np.diff(block.owner[by_place]).astype(bool)) + 1
    lengths = np.diff(np.concatenate([[0], change, [len(common)]]))
    keep[by_place[common & (np.repeat(lengths, lengths) >= COMMON_RUN)]] = True
    order = np.lexsort((block.place, counts, block.owner))
    first = np.searchsorted(block.owner[order], block.owner[order])
    keep[order[np.arange(len(order)) - first < LEAST_SEEDS]] = True
    return Items(block.ids, block.words, block.vocabulary, block.seeds[keep], block.owner[keep], block.place[keep], block.sizes)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and where in ``window`` it ends. 0 never matches."""
    steps = np.arange(len(window) + 1) * -GAP
    before = np.zeros(len(window) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(before + GAP, 0)
        row[1:] = np.maximum(row[1:], before[:-1] + np.where((window == word) & (word > 0), MATCH, MISMATCH))
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        before = row
    return best, end


def best_match(words: np.ndarray, block: Items) -> tuple[float, int | None]:
    """The highest share of a whole copy's score among the block's items, and that item."""
    at, seed = _hits(words, block)
    found: dict[int, list[int]] = {}
    for p, k in zip(at.tolist(), seed.tolist()):
        value = block.seeds[k]
        while k < len(block.seeds) and block.seeds[k] == value:
            found.setdefault(int(block.owner[k]), []).append(p - int(block.place[k]))
            k += 1
    score, which = 0.0, None
    for owner, begins in sorted(found.items(), key=lambda x: block.ids[x[0]] if block.ids[x[0]] is not None else -1):
        item = block.words[owner]
        pad, here = len(item) // 2 + 8, 0
        spans: list[list[int]] = []
        for b in sorted(set(begins)):
            lo, hi = max(0, b - pad), min(len(words), b + len(item) + pad)
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        for lo, hi in spans:
            here = max(here, align(item, words[lo:hi])[0])
        share = here / (MATCH * len(item))
        if share > score:
            score, which = share, block.ids[owner]
    return score, which


def score(documents: DataFrame, benchmark: DataFrame, score_column: str = "score", item_column: str = "item_id") -> DataFrame:
    """``documents`` with the best alignment score (0 to 1, 0 if no seed is hit) and its item, for every row."""
    n = documents.count()
    out = documents.withColumns({score_column: F.lit(0.0), item_column: F.lit(None).cast("long")})
    for block in blocks(benchmark):
        seeds = rare(block, document_counts(documents, block), n)
        shared = documents.sparkSession.sparkContext.broadcast(seeds)

        def make(shared=shared):
            def run(texts, scores, items):
                own, best_scores, best_items = shared.value, [], []
                for text, s, i in zip(texts, scores, items):
                    got, item = best_match(_known(text, own.vocabulary), own)
                    best_scores.append(max(s, got))
                    best_items.append(item if got > s else i)
                return best_scores, best_items

            return run

        a, b = fresh(out, "best_score"), fresh(out, "best_item")
        given, text = whole_text(out)
        wider = per_row(given, [text, score_column, item_column], [StructField(a, DoubleType()), StructField(b, LongType())], make)
        out = wider.select(*[c for c in documents.columns], F.col(a).alias(score_column), F.col(b).alias(item_column))
    return out


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_id and score of every row."""
    rows = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    hit = F.col("score") >= THRESHOLD
    return rows.select("doc_id", hit.alias("contaminated"), F.when(hit, F.col("item_id")).alias("item_id"), "score")


def remove_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that aren't contaminated, with their own columns."""
    s, i = fresh(documents, "leak_score"), fresh(documents, "leak_item")
    return score(documents, benchmark, s, i).where(F.col(s) < THRESHOLD).select(*documents.columns)
