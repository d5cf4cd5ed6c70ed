"""Language identification: script ranges, per-word scores, and Viterbi over languages.

Character n-gram models of the learned languages give every word one score per
language. The scripts of a word's letters narrow the languages it can be scored
for. A Viterbi pass with a penalty for switching labels each word, so mixed texts
fall into spans; the language with most labelled letters is the text's.

Texts in which no stretch of words could repay its switches (checked exactly from the
running sums) need no pass, as a single language is the best path; in others, languages
that no word favours over the best single one stay out, as they can't improve a path.

Defined results: null texts and texts without a letter are ``und`` with score 0;
repeated rows get equal result rows; ties take the language that sorts first;
very long texts are labelled whole; without learned languages everything is ``und``; an empty table gives no rows;
further columns pass unseen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from strata.llm.common import crc_mod, per_row

#: Slots of the hashed letter pairs and triples.
SLOTS = 1 << 17
#: Sampled texts of each language, about, and the longest one taken.
SAMPLE, SAMPLE_CHARS = 400, 20_000
SMOOTH = 0.5
#: What a switch costs, in log units, and the most that one word may tell.
SWITCH, WORD_LIMIT = 12.0, 4.0

SPANS = ArrayType(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())]))

# First and last code point of scripts.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Thai": [(0xE00, 0xE7F)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}

@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For the code points of the basic plane: the lower-case letter (0 if none) and the script's number."""
    lower, kind = np.zeros(1 << 16, np.uint32), np.full(1 << 16, len(SCRIPTS), np.uint8)
    for n in range(1 << 16):
        c = chr(n)
        if c.isalpha():
            low = c.lower()
            lower[n] = ord(low) if len(low) == 1 else n
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            kind[a: b + 1] = k
    return lower, kind


@dataclass
class Words:
    """The words (runs of letters) of several texts, and the hashed pairs and triples of their letters, ends included."""

    text: np.ndarray  # of each word, the number of its text
    letters: np.ndarray  # of each word, how many
    script: np.ndarray  # of each word's first letter
    first: np.ndarray  # of each word, its first place in the slots
    pairs: np.ndarray
    triples: np.ndarray
    begin: np.ndarray  # of each word, its first character in its text


def words_of(texts: list[str | None]) -> Words:
    lower, kind = _characters()
    joined = "\n" + "\n".join([t or "" for t in texts]) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = lower[np.minimum(raw, 0xFFFF)]
    far = np.flatnonzero(raw > 0xFFFF)
    c[far] = [n if chr(n).isalpha() else 0 for n in raw[far].tolist()]
    letter = c > 0
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    place = letter.copy()
    place[1:] |= letter[:-1]  # a word's letters and the place behind it
    at = np.flatnonzero(place)
    before = c[at - 1].astype(np.uint64)
    twice = np.where(before > 0, c[np.maximum(at - 2, 0)], 0).astype(np.uint64)
    here = c[at].astype(np.uint64)
    pair = before * np.uint64(0x9E3779B1) + here
    triple = (twice * np.uint64(0x85EBCA6B) + pair) * np.uint64(0xC2B2AE3D)
    pair = pair * np.uint64(0x9E3779B97F4A7C15)
    begins = np.flatnonzero(start)
    first = np.searchsorted(at, begins)
    ends = np.append(np.cumsum([1 + len(t or "") for t in texts]), np.iinfo(np.int64).max)
    of = np.searchsorted(ends, begins, side="right")
    return Words(
        of, np.diff(np.append(first, len(at))) - 1, np.where(raw[begins] <= 0xFFFF, kind[np.minimum(raw[begins], 0xFFFF)], len(SCRIPTS)),
        first, (pair >> np.uint64(40)).astype(np.int64) & (SLOTS - 1), (triple >> np.uint64(24)).astype(np.int64) & (SLOTS - 1),
        begins - np.append(0, ends[:-1])[of] - 1,
    )


@dataclass
class Model:
    languages: list[str]
    pairs: np.ndarray  # slots x languages, log probabilities
    triples: np.ndarray
    able: np.ndarray  # scripts x languages: is the script used


def fit(texts: list[str], languages: list[str]) -> Model:
    names = sorted(set(languages))
    pairs, triples = np.zeros((SLOTS, len(names))), np.zeros((SLOTS, len(names)))
    used = np.zeros((len(SCRIPTS) + 1, len(names)))
    for k, lang in enumerate(names):
        w = words_of([t for t, x in zip(texts, languages) if x == lang])
        pairs[:, k], triples[:, k] = np.bincount(w.pairs, minlength=SLOTS), np.bincount(w.triples, minlength=SLOTS)
        used[:, k] = np.bincount(w.script, minlength=len(used))
    logs = [np.log((x + SMOOTH) / (x.sum(axis=0) + SMOOTH * max(1, (x.sum(axis=1) > 0).sum()))).astype(np.float32) for x in (pairs, triples)]
    return Model(names, *logs, used > 0.01 * np.maximum(used.sum(axis=0), 1))


def _two(edge: np.ndarray) -> np.ndarray:
    """Viterbi for two states from the second's edge over the first at each word: is it the second?"""
    d, seen = 0.0, []
    for x in edge.tolist():
        d = (SWITCH if d > SWITCH else -SWITCH if d < -SWITCH else d) + x
        seen.append(d)
    out = np.zeros(len(seen), dtype=bool)
    state = d > 0
    for t in range(len(seen) - 1, -1, -1):
        if state and seen[t] < -SWITCH and t < len(seen) - 1:
            state = False
        elif not state and seen[t] > SWITCH and t < len(seen) - 1:
            state = True
        out[t] = state
    return out


def _many(scores: np.ndarray) -> np.ndarray:
    """Viterbi for any number of states."""
    n = scores.shape[1]
    back = np.empty(scores.shape, dtype=np.int32)
    v, stay = scores[0].tolist(), list(range(n))
    for t, row in enumerate(scores[1:].tolist(), 1):
        top = max(v)
        k, least = v.index(top), top - SWITCH
        back[t] = [x if v[x] >= least else k for x in stay]
        v = [(a if a >= least else least) + b for a, b in zip(v, row)]
    out = np.empty(len(scores), dtype=np.int64)
    out[-1] = v.index(max(v))
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


class Labeller:
    def __init__(self, model: Model):
        self.model, self.n = model, len(model.languages)

    def word_scores(self, w: Words) -> np.ndarray:
        """Log scores relative to the best language, averaged over pairs and triples and bounded.

        A language that doesn't use the script of a word gets the bound, unless none does.
        """
        if not len(w.first):
            return np.zeros((0, self.n))
        both = np.take(self.model.pairs, w.pairs, axis=0)
        both += np.take(self.model.triples, w.triples, axis=0)
        sums = np.add.reduceat(both, w.first, axis=0) / np.float32(2)
        able = self.model.able[w.script]
        sums = np.where(able | ~able.any(axis=1, keepdims=True), sums, -np.inf)
        return np.maximum(sums - sums.max(axis=1, keepdims=True), -WORD_LIMIT)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language for each word under the switching penalty.

        Against the best single language a path of k segments gains at most what its
        first, last and middle segments can, less k - 1 switches. If no stretch gains more
        than a switch, and no beginning and end together do, none gains anything.
        """
        total = scores.cumsum(axis=0, dtype=np.float64)
        best = int(total[-1].argmax())
        gain = total - total[:, best: best + 1]
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        opening, closing = max(0.0, gain.max()), max(0.0, (gain[-1] - low[-1]).max())
        if (gain - low).max() <= SWITCH and opening + closing <= SWITCH:
            return np.full(len(scores), best)
        names = np.flatnonzero((scores > scores[:, best: best + 1]).any(axis=0))
        if len(names) == 1:
            return np.where(_two(scores[:, names[0]] - scores[:, best]), names[0], best)
        names = np.append(best, names)
        return names[_many(scores[:, names])]

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.labelled(texts)[:2]

    def labelled(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
        """Each text's language, that language's share of the letters, and the spans of words of one language."""
        languages, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if self.n:
            w = words_of(texts)
            told = self.word_scores(w)
            edges = np.searchsorted(w.text, np.arange(len(texts) + 1))
            end = w.begin + w.letters
            for t in range(len(texts)):
                lo, hi = edges[t], edges[t + 1]
                if hi > lo:
                    path = self.path(told[lo:hi])
                    share = np.bincount(path, weights=w.letters[lo:hi], minlength=self.n) / w.letters[lo:hi].sum()
                    k = int(share.argmax())
                    languages[t], scores[t] = self.model.languages[k], float(min(1.0, share[k]))
                    turns = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), hi - lo]
                    spans[t] = [{"begin": int(w.begin[lo + a]), "end": int(end[lo + b - 1]), "lang": self.model.languages[path[a]]} for a, b in zip(turns, turns[1:])]
        return languages, scores, spans


def train(documents: DataFrame) -> Model:
    """Learn from about SAMPLE texts of each language, drawn by a hash among rows that aren't held out."""
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 5) != 0) & (F.length("text") <= SAMPLE_CHARS))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    cut = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, SAMPLE / n) * (1 << 30)))])
    rows = known.where(draw < cut[F.col("lang")]).select("text", "lang", "doc_id").orderBy(draw, "doc_id", "text").limit(2 * SAMPLE * len(sizes)).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans (begin, end, lang; in characters, from the first letter to behind the last) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("whole_text"))
    found = per_row(rows, ["whole_text"], [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", SPANS)], lambda: Labeller(shared.value).labelled)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "spans")
