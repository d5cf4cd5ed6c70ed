"""Periodic runs of words: suffix classes united by decreasing common prefix.

Words of a text and its suffixes are ranked by prefix doubling, and neighbours in suffix
order are edges weighted by their longest common prefix. Edges are taken from the longest
prefix down, as Kruskal's algorithm does: each unites two classes of suffixes in a
union-find whose classes are ordered sets of positions, the smaller put into the larger.
Positions i < j that become neighbours in a class share exactly the edge's prefix; if they
lie no further apart than that, the words from i to j's prefix end repeat with the smallest
period j - i. The first such i of a period and an end is where the run begins.

A run of length max(24, 3 periods) starts with two suffixes that share at least 16 words, so only
edges of that length matter, and texts in which no 16 words occur twice have no runs.

Texts are worked on in slices of a bounded number of characters (a longer text is a slice
of its own; memory is linear in it, times the logarithm of its longest repeat).

Defined cases: null texts have no words; every row gives one row, repeated rows too; a null
id counts as the empty text where ids are hashed; other columns are not looked at. Of runs
with equal exponents the one that starts first, then the one with the smaller period, is
the greatest. Empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has this many words and periods at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: What the first two periods' suffixes of a run share at least: the least of max(24, 3q) - q.
LEAST_SHARED = min(max(LEAST_WORDS, LEAST_PERIODS * q) - q for q in range(1, LEAST_WORDS + 1))
#: Characters of a slice.
SLICE_CHARS = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _repeating(texts: list[list[str]]) -> list[int]:
    """Texts in which LEAST_SHARED words may occur twice: equal hashes of such windows (others may be named, none is missed)."""
    lengths = np.array([len(t) for t in texts])
    if not lengths.sum():
        return []
    h = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(lengths.sum())).astype(np.uint64) * _MIX
    h ^= h >> np.uint64(29)
    span, step = 1, _MIX
    while 2 * span <= LEAST_SHARED:
        h = h[: max(len(h) - span, 0)] * step + h[span:]
        span, step = 2 * span, np.uint64(int(step) ** 2 % 2**64)
    owner, ends = np.repeat(np.arange(len(texts)), lengths), np.repeat(np.cumsum(lengths), lengths)
    inside = np.arange(len(h)) + span <= ends[: len(h)]
    h, owner = (h ^ (owner[: len(h)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))[inside], owner[: len(h)][inside]
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.unique(owner[order][1:][same]).tolist()


def suffix_edges(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common): neighbours in suffix order that share at least LEAST_SHARED words of one text; ``words`` differ between texts, ``ends`` is each position's text end."""
    total = len(words)
    places = np.arange(total)

    def after(rank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """The rank ``step`` words on, and -1 past the text's end."""
        inside = at + step < ends[at]
        return np.where(inside, rank[np.minimum(at + step, total - 1)], -1)

    rank = np.searchsorted(np.sort(words), words)
    levels, step, active, shared = [rank.astype(np.int32)], 1, places, places[:0]
    while len(active):
        key = rank[active] * (total + 1) + after(rank, active, step) + 1
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        base = rank[active]
        new_class = np.r_[True, base[1:] != base[:-1]]
        new_part = np.r_[True, key[1:] != key[:-1]]
        at = np.arange(len(active))
        first_of_class = np.maximum.accumulate(np.where(new_class, at, 0))
        first_of_part = np.maximum.accumulate(np.where(new_part, at, 0))
        rank = rank.copy()
        rank[active] = base + first_of_part - first_of_class
        levels.append(rank.astype(np.int32))
        step *= 2
        alone = new_part & np.r_[new_part[1:], True]
        active = active[~alone]
        if 2 * step > LEAST_SHARED >= step:
            shared = active
    order = shared[np.argsort(rank[shared], kind="stable")]
    i, j = order[:-1], order[1:]
    common = np.zeros(len(i), dtype=np.int64)
    for level, r in reversed(list(enumerate(levels))):
        a, b = i + common, j + common
        inside = (a < ends[i]) & (b < ends[j])
        equal = inside & (r[np.minimum(a, total - 1)] == r[np.minimum(b, total - 1)])
        common += np.where(equal, 1 << level, 0)
    enough = common >= LEAST_SHARED
    return i[enough], j[enough], common[enough]


def united(i: np.ndarray, j: np.ndarray, common: np.ndarray) -> dict[tuple[int, int], int]:
    """The first start of each (period, end) that newly neighbouring positions of the united classes show."""
    places, both = np.unique(np.concatenate([i, j]), return_inverse=True)
    order = np.argsort(-common, kind="stable")
    left, right = both[: len(i)][order].tolist(), both[len(i) :][order].tolist()
    at = places.tolist()
    parent, members = list(range(len(at))), [[p] for p in range(len(at))]
    starts: dict[tuple[int, int], int] = {}

    def seed(a: int, b: int, shared: int) -> None:
        period = at[b] - at[a]
        if period <= shared:
            run = (period, at[b] + shared)
            if at[a] < starts.get(run, at[a] + 1):
                starts[run] = at[a]

    for x, y, shared in zip(left, right, common[order].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        large, small = (x, y) if len(members[x]) >= len(members[y]) else (y, x)
        into, put = members[large], members[small]
        members[small] = []
        parent[small] = large
        before = -1
        for nth, p in enumerate(put):
            k = bisect_left(into, p)
            if k and into[k - 1] != before:
                seed(into[k - 1], p, shared)
            if k < len(into) and (nth + 1 == len(put) or put[nth + 1] > into[k]):
                seed(p, into[k], shared)
            into.insert(k, p)
            before = p
    return starts


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = _repeating(texts)
    if not some:
        return out
    lengths = np.array([len(texts[t]) for t in some])
    ids, known = pd.factorize(np.array([w for t in some for w in texts[t]], dtype=object))
    owner = np.repeat(np.arange(len(some)), lengths)
    offsets = np.cumsum(lengths) - lengths
    for (period, end), start in united(*suffix_edges(owner * len(known) + ids, (offsets + lengths)[owner])).items():
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
            t = int(owner[start])
            out[some[t]].append((start - int(offsets[t]), end - start, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words outside all runs' repeats, joined by spaces; a run's first period stays unless another run repeats it."""
    if not runs:
        return " ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return " ".join(w for w, n in zip(words, np.cumsum(change).tolist()) if not n)


def planted(doc_id: object, words: list[str]) -> list[str]:
    """Every tenth text by its id's hash repeats a part of itself from some word on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` characters of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto


RUN = "struct<start: bigint, length: bigint, period: bigint>"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """(key, n_words, runs, greatest, collapsed) of every text; ``rewrite`` changes a text's words before."""
    chosen = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    id_type = chosen.schema["key"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def named(run: tuple[int, int, int]) -> dict[str, int]:
        return dict(zip(("start", "length", "period"), run))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, SLICE_CHARS):
                texts = [WORD.findall(t or "") for t in part.column("text").to_pylist()]
                if rewrite is not None:
                    texts = [rewrite(k, t) for k, t in zip(part.column("key").to_pylist(), texts)]
                found = runs_of(texts)
                greatest = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None) for r in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"), pa.array([len(t) for t in texts], pa.int64()), pa.array([[named(x) for x in r] for r in found], pa.list_(run_type)),
                        pa.array([g and named(g) for g in greatest], run_type), pa.array([collapsed(t, r) for t, r in zip(texts, found)], pa.string()),
                    ],
                    names=[key, "n_words", "runs", "greatest", "collapsed"],
                )

    return chosen.mapInArrow(find, f"{key} {id_type}, n_words bigint, runs array<{RUN}>, greatest {RUN}, collapsed string")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of numbers and digests a text, from what ``find_runs`` gives."""
    g = F.col("greatest")
    exponent: Column = F.expr("(1000 * greatest.length) div greatest.period")
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        key, F.size("runs").cast("bigint").alias("n_runs"), g["start"].alias("start"), g["length"].alias("length"), g["period"].alias("period"), exponent.alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
