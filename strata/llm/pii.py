"""Personal data by patterns and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. A tagger (numpy only) is trained on labelled spans
of a bounded sample of texts: the spans that patterns find there (numbers of a card's
form whether or not their check digit is right), and rewritten forms of half of them
(spaced, dotted, slashed, bracketed or spelled), whose places are known because they
were put there. It labels characters in overlapping windows; their emissions and
marginal probabilities are blended, each weighing most in its window's middle, and one
Viterbi pass with the learned transitions reconciles a whole region. Decoded spans
that touch no base span, are certain enough and look like their kind are added.

Every form has a digit, an at sign or a spelled or bracketed one in it, so characters
farther than half a window from any of these can only be outside; windows are laid
over all the rest of every whole text.

Defined results: null and empty texts have no spans; repeated rows get equal result
rows; very long texts are read whole, in time proportional to their length; ties do
not arise (spans of a kind never overlap); without a span in the sample nothing is
added; an empty table gives no rows; further columns pass unseen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from strata.llm.common import fresh, per_row, whole_text

KINDS = ("email", "ip", "card", "phone")
# The base forms. The first two are found in pieces below, as runs of letters or digits would cost their square.
EMAIL_NAME = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP_RUN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PATTERNS = {
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_SPELLED = r"[\[({<]\s?(?:at|dot)\s?[\])}>]|\bdot\b"
GATE = re.compile(rf"[0-9@]|{_SPELLED}", re.I)
_BASE_GATE = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")

WINDOW, STRIDE = 64, 32
EMBED, HIDDEN = 8, 16
#: Texts of the training sample, and windows taken from them.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 600, 4000
#: Longest text, in characters, that the training sample takes.
SAMPLE_CHARS = 20_000
STEPS, BATCH, RATE = 240, 32, 0.025
#: Mean probability that an added span needs; above a half, so a region in which no character is rather inside than outside has none.
CERTAIN = 0.7

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    digits = NOT_DIGIT.sub("", found)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _emails(text: str) -> list[Span]:
    """Around each at sign: the name is the run of its characters before it, down to the last match's end."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        name = len(before) - len(before.rstrip(EMAIL_NAME))
        host = EMAIL_HOST.match(text, at) if name else None
        if host:
            out.append(("email", at - name, host.end()))
        low = host.end() if host else at + 1
        at = text.find("@", low)
    return out


def _addresses(text: str) -> list[Span]:
    """Of each run of numbers joined by dots, every four numbers are a match."""
    out = []
    for m in IP_RUN.finditer(text):
        if m.group().count(".") >= 3:
            parts, at = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k: k + 4]
                size = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append(("ip", at, at + size))
                at += size + 1
    return out


def base_spans(text: str | None) -> list[Span]:
    """Pattern matches by kind, then start; a match that fails its test is dropped without another try."""
    if not text or not _BASE_GATE.search(text):
        return []
    found = (_emails(text) if "@" in text else []) + _addresses(text)
    return found + [(k, m.start(), m.end()) for k, pattern in PATTERNS.items() for m in pattern.finditer(text) if _holds(k, m.group())]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# Characters fall into classes: letters by themselves, digits together, marks that occur in the kinds, and the rest.
_MARKS = "@.+-_%() \n:/,=\"'[]{}<>"
_CLASS = {c: i for i, c in enumerate(_MARKS, 3)}
_CLASSES = 3 + len(_MARKS) + 26 + 1
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
K = len(TAGS)


def char_class(c: str) -> int:
    """0 pads, 1 is any other character, 2 a digit."""
    if "0" <= c <= "9":
        return 2
    if c in _CLASS:
        return _CLASS[c]
    low = c.lower()
    return 3 + len(_MARKS) + ord(low) - 97 if "a" <= low <= "z" else 1


def classes(text: str) -> np.ndarray:
    return np.fromiter(map(_class_of, text), dtype=np.int64, count=len(text))


class _Memo(dict):
    def __missing__(self, c: str) -> int:
        if len(self) > 50_000:
            self.clear()
        got = self[c] = char_class(c)
        return got


_class_of = _Memo().__getitem__


@dataclass
class Tagger:
    p: dict[str, np.ndarray]


def _init(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"embed": rng.normal(0, 0.5, (_CLASSES, EMBED)), "out": draw(2 * HIDDEN, K), "out_b": np.zeros(K), "move": np.zeros((K, K)), "first": np.zeros(K)}
    for d in "fb":
        p[f"{d}_w"] = draw(EMBED + HIDDEN, 4 * HIDDEN)
        p[f"{d}_b"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states over time (T, B, HIDDEN) of inputs (T, B, EMBED); gates are input, forget, output, candidate."""
    T, B = x.shape[:2]
    h, c, out, kept = np.zeros((B, HIDDEN)), np.zeros((B, HIDDEN)), np.zeros((T, B, HIDDEN)), []
    projected = x @ w[:EMBED] + b
    for t in range(T):
        z = projected[t] + h @ w[EMBED:]
        s, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN: 2 * HIDDEN], s[:, 2 * HIDDEN:]
        before, past = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        kept.append((i, f, o, g, before, tc, past))
    return out, kept


def _lstm_back(grad: np.ndarray, x: np.ndarray, kept: list, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    T, B = x.shape[:2]
    dz = np.zeros((T, B, 4 * HIDDEN))
    dh, dc = np.zeros((B, HIDDEN)), np.zeros((B, HIDDEN))
    dw_h = np.zeros((HIDDEN, 4 * HIDDEN))
    for t in range(T - 1, -1, -1):
        i, f, o, g, before, tc, past = kept[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dw_h += past.T @ dz[t]
        dh, dc = dz[t] @ w[EMBED:].T, dc * f
    flat = dz.reshape(T * B, -1)
    return dz @ w[:EMBED].T, np.concatenate([x.reshape(T * B, -1).T @ flat, dw_h]), flat.sum(axis=0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _emissions(p: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, tuple]:
    x = p["embed"][ids]
    ahead, kf = _lstm(x, p["f_w"], p["f_b"])
    back, kb = _lstm(x[::-1], p["b_w"], p["b_b"])
    h = np.concatenate([ahead, back[::-1]], axis=2)
    return h @ p["out"] + p["out_b"], (x, kf, kb, h)


def _marginals(p: dict[str, np.ndarray], e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward scores, node probabilities and the total log score of emissions (T, B, K)."""
    T = len(e)
    ahead, back = np.zeros_like(e), np.zeros_like(e)
    ahead[0] = e[0] + p["first"]
    for t in range(1, T):
        ahead[t] = e[t] + _logsum(ahead[t - 1][:, :, None] + p["move"][None], 1)
    for t in range(T - 2, -1, -1):
        back[t] = _logsum(p["move"][None] + (e[t + 1] + back[t + 1])[:, None, :], 2)
    z = _logsum(ahead[-1], 1)
    return ahead, back, z


def probabilities(p: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal probabilities and emissions of windows (T, B): each (T, B, K)."""
    e, _ = _emissions(p, ids)
    ahead, back, z = _marginals(p, e)
    return np.exp(ahead + back - z[None, :, None]), e


def _gradients(p: dict[str, np.ndarray], ids: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
    e, (x, kf, kb, h) = _emissions(p, ids)
    ahead, back, z = _marginals(p, e)
    T, B = ids.shape
    de = np.exp(ahead + back - z[None, :, None])
    move = np.zeros((K, K))
    for t in range(1, T):
        move += np.exp(ahead[t - 1][:, :, None] + p["move"][None] + (e[t] + back[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    np.subtract.at(move, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    first = de[0].sum(axis=0) - np.bincount(gold[0], minlength=K)
    np.subtract.at(de, (np.arange(T)[:, None], np.arange(B)[None, :], gold), 1)
    dh = de @ p["out"].T
    dxf, fw, fb = _lstm_back(dh[:, :, :HIDDEN], x, kf, p["f_w"])
    dxb, bw, bb = _lstm_back(dh[::-1, :, HIDDEN:], x[::-1], kb, p["b_w"])
    embed = np.zeros_like(p["embed"])
    np.add.at(embed, ids, dxf + dxb[::-1])
    flat = h.reshape(T * B, -1)
    g = {"embed": embed, "out": flat.T @ de.reshape(T * B, -1), "out_b": de.sum(axis=(0, 1)), "move": move, "first": first, "f_w": fw, "f_b": fb, "b_w": bw, "b_b": bb}
    return {k: v / B for k, v in g.items()}


def train(windows: np.ndarray, gold: np.ndarray, seed: int = 11) -> Tagger:
    """Adam on the CRF's log likelihood; ``windows`` and ``gold`` are (count, WINDOW)."""
    p = _init(seed)
    if len(windows):
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(windows), BATCH)
            g = _gradients(p, windows[at].T, gold[at].T)
            scale = min(1.0, 5 / max(1e-9, np.sqrt(sum((x**2).sum() for x in g.values()))))
            rate = RATE * (1 - step / (STEPS + 1))
            for k in p:
                d = g[k] * scale
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Tagger(p)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within half a window of a digit or an at sign."""
    out: list[list[int]] = []
    for m in GATE.finditer(text):
        lo, hi = max(0, m.start() - WINDOW // 2), min(len(text), m.end() + WINDOW // 2)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def window_starts(lo: int, hi: int) -> list[int]:
    return list(range(lo, max(lo + 1, hi - STRIDE), STRIDE))


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        tags[a], tags[a + 1: b] = k, k + 1
    return tags


def _separated(rng: np.random.Generator, parts: list[str]) -> str:
    return str(rng.choice([".", "/", " - ", "  ", " . ", "_", "-"])).join(parts)


def rewritten(kind: str, found: str, rng: np.random.Generator) -> str:
    """A form of a span that the base patterns don't take."""
    digits = NOT_DIGIT.sub("", found)
    if kind == "email":
        name, _, host = found.rpartition("@")
        at, dot = [(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot "), (" @ ", "."), ("{at}", "{dot}"), ("<at>", ".")][rng.integers(7)]
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return [" . ", "[.]", "(.)", " dot ", "[dot]"][rng.integers(5)].join(found.split("."))
    if kind == "card":
        return _separated(rng, [digits[i: i + 4] for i in range(0, len(digits), 4)])
    tail = [digits[-10:-7], digits[-7:-4], digits[-4:]]
    return [lambda: f"({tail[0]}) {tail[1]}-{tail[2]}", lambda: f"00{digits[:-10]} " + " ".join(tail), lambda: _separated(rng, tail), lambda: f"({tail[0]}){tail[1]}.{tail[2]}"][rng.integers(4)]()


def seen_spans(text: str) -> list[Span]:
    """The spans a text is labelled with: base ones and numbers of a card's form whose check digit is wrong, none over another (the longest count)."""
    spans = base_spans(text) + [("card", m.start(), m.end()) for m in PATTERNS["card"].finditer(text) if 16 <= len(NOT_DIGIT.sub("", m.group())) <= 19]
    out: list[Span] = []
    for kind, a, b in sorted(set(spans), key=lambda s: (s[1] - s[2], s[1])):
        if all(b <= x or y <= a for _, x, y in out):
            out.append((kind, a, b))
    return sorted(out, key=lambda s: s[1])


def labelled(text: str, rng: np.random.Generator, share: float = 0.5) -> tuple[str, list[Span]]:
    """A text with about ``share`` of its spans rewritten, and where all of them are now."""
    made, spans, at, size = [], [], 0, 0
    for kind, a, b in seen_spans(text):
        form = rewritten(kind, text[a:b], rng) if rng.random() < share else text[a:b]
        made += [text[at:a], form]
        size += a - at
        spans.append((kind, size, size + len(form)))
        size, at = size + len(form), b
    return "".join([*made, text[at:]]), spans


def training_windows(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows over the regions of texts whose spans were partly rewritten, and their tags."""
    rng = np.random.default_rng(seed)
    ids, gold = [], []
    for raw in texts:
        text, spans = labelled(raw, rng)
        c, tags = classes(text), tags_of(len(text), spans)
        for lo, hi in regions(text):
            for a in window_starts(lo, hi):
                pad = (0, WINDOW - len(c[a: a + WINDOW]))
                ids.append(np.pad(c[a: a + WINDOW], pad)), gold.append(np.pad(tags[a: a + WINDOW], pad))
                if len(ids) >= SAMPLE_WINDOWS:
                    return np.array(ids), np.array(gold)
    return (np.array(ids), np.array(gold)) if ids else (np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64))


_ALLOWED = np.full((K, K), -1e9)
for _a in range(K):
    for _b in range(K):
        if _b == 0 or _b % 2 == 1 or _a in (_b, _b - 1):
            _ALLOWED[_a, _b] = 0.0


def reconcile(blend: np.ndarray, scores: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """The best tag sequence of a region under blended emissions and the learned transitions, in which every inside tag follows its own kind."""
    path = np.zeros(len(scores), dtype=np.int64)
    if blend.argmax(axis=1).max() == 0:
        return path
    move = p["move"] + _ALLOWED
    best = scores[0] + p["first"]
    best[2::2] = -1e9
    back = np.zeros(scores.shape, dtype=np.int64)
    for t in range(1, len(scores)):
        step = best[:, None] + move
        back[t] = step.argmax(axis=0)
        best = step.max(axis=0) + scores[t]
    path[-1] = int(best.argmax())
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


# What an added span may be made of, by kind.
_LOOKS = {
    "email": re.compile(r"[\w.%+-]+\s*(?:@|[\[({<]\s?at\s?[\])}>]|\bat\b)\s*[\w.()\[\]{}<>\s-]+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:[\s.\[\](){}<>]|dot){1,9}[0-9]{1,3}){3}", re.I),
    "card": re.compile(r"[0-9][0-9\s./_-]+[0-9]"),
    "phone": re.compile(r"[+(]?[0-9][0-9\s()./_-]+[0-9]"),
}


def plausible(kind: str, found: str) -> bool:
    """Whether a decoded span looks like its kind."""
    digits = len(NOT_DIGIT.sub("", found))
    return len(found) <= 320 and _LOOKS[kind].fullmatch(found) is not None and (kind in ("email", "ip") or (13 <= digits <= 19 if kind == "card" else 7 <= digits <= 15))


def added_spans(texts: list[str | None], bases: list[list[Span]], tagger: Tagger, batch: int = 512) -> list[list[Span]]:
    """Spans that the tagger adds to each text; windows of many texts are decoded together."""
    jobs, owners = [], []
    coded = {}
    for n, text in enumerate(texts):
        if text and GATE.search(text):
            coded[n] = c = classes(text)
            for lo, hi in regions(text):
                for a in window_starts(lo, hi):
                    jobs.append(np.pad(c[a: a + WINDOW], (0, WINDOW - len(c[a: a + WINDOW])))), owners.append((n, lo, hi, a))
    out: list[list[Span]] = [[] for _ in texts]
    bell = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)
    blends: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def close(key: tuple[int, int, int]) -> None:
        n, lo, hi = key
        total, scores, weight = blends.pop(key)
        blend = total / np.maximum(weight, 1e-9)[:, None]
        path, t = reconcile(blend, scores / np.maximum(weight, 1e-9)[:, None], tagger.p), 0
        while t < len(path):
            if path[t] % 2:
                end = t + 1
                while end < len(path) and path[end] == path[t] + 1:
                    end += 1
                kind, a, b = KINDS[path[t] // 2], lo + t, lo + end
                sure = blend[np.arange(t, end), path[t:end]].mean()
                if sure >= CERTAIN and plausible(kind, texts[n][a:b]) and not any(a < y and x < b for _, x, y in bases[n]):
                    out[n].append((kind, a, b))
                t = end
            else:
                t += 1

    for at in range(0, len(jobs), batch):
        probs, emitted = probabilities(tagger.p, np.array(jobs[at: at + batch]).T)
        for k, (n, lo, hi, a) in enumerate(owners[at: at + batch]):
            key = (n, lo, hi)
            if key not in blends:
                for other in list(blends):
                    close(other)
                blends[key] = (np.zeros((hi - lo, K)), np.zeros((hi - lo, K)), np.zeros(hi - lo))
            total, scores, weight = blends[key]
            size = min(WINDOW, hi - a)
            total[a - lo: a - lo + size] += probs[:size, k] * bell[:size, None]
            scores[a - lo: a - lo + size] += emitted[:size, k] * bell[:size, None]
            weight[a - lo: a - lo + size] += bell[:size]
    for key in list(blends):
        close(key)
    return out


def fit(documents: DataFrame) -> Tagger:
    """Train on windows of a bounded sample: about SAMPLE_TEXTS texts with a digit or an at sign, drawn by a hash.

    Such texts are counted first, so that every task sends its share of the sample only.
    """
    text = F.col("text").cast("string")
    able = documents.select(text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("draw")).where(text.rlike("[0-9@]") & (F.length(text) <= SAMPLE_CHARS))
    share = min(1.0, 1.5 * SAMPLE_TEXTS / max(1, able.count()))
    rows = able.where(F.col("draw") < int(share * (1 << 30))).orderBy("draw", "text").limit(SAMPLE_TEXTS).collect()
    return train(*training_windows([r["text"] for r in rows]))


def _finder(tagger: Tagger) -> Callable:
    def run(texts):
        bases = [base_spans(t) for t in texts]
        more = added_spans(texts, bases, tagger)
        base = [joined(b) for b in bases]
        return (
            *[[sum(s[0] == k for s in b) for b in bases] for k in KINDS],
            [hashlib.sha256(b.encode()).hexdigest() for b in base],
            [joined(b + m) for b, m in zip(bases, more)],
            [len(m) for m in more],
        )

    return run


_FIELDS = [*[StructField(f"n_{k}", LongType()) for k in KINDS], StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("n_added", LongType())]


def find(documents: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256, all spans and the number of added ones, for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("whole_text"))
    return per_row(rows, ["whole_text"], _FIELDS, lambda: _finder(shared.value)).drop("whole_text")


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longest, counts."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with all found spans replaced in ``text`` (and ``n_chars`` counted anew, if there is one)."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents))
    name = fresh(documents, "clean_text")

    def make():
        def run(texts):
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, bases, shared.value)
            out = [redacted(t, b + m) for t, b, m in zip(texts, bases, more)]
            for i, t in enumerate(out):  # a match that failed beside another may stand alone now
                while rest := base_spans(t):
                    t = out[i] = redacted(t, rest)
            return (out,)

        return run

    given, whole = whole_text(documents)
    rows = per_row(given, [whole], [StructField(name, StringType())], make)
    changed = {"text": F.col(name)} | ({"n_chars": F.when(F.col(whole) == F.col(name), F.col("n_chars")).otherwise(F.length(name)).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in documents.columns])
