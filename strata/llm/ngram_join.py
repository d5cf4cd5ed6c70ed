"""N-gram Jaccard self join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two texts are linked if the Jaccard
similarity of their sets is 0.8 or more. Steps:

1. Equal texts are one node (the MD5 of the text); only distinct texts go on.
2. Each node has 80 MinHash values in 20 bands of 4. Nodes that share a band are
   candidates: a pair at the threshold shares one with probability 1 - 3e-5.
3. Candidate pairs compare their MinHash values 16 at a time; a pair is dropped as
   soon as the posterior probability (uniform prior) that its similarity reaches
   the threshold falls below a tolerance. Large buckets are cut into blocks, and
   pairs of blocks are dealt out as tasks; as only the connection matters here,
   nodes already connected in a block are not compared again.
4. Connected survivors form tight groups. In each group, again in pairs of blocks,
   every pair of different texts is verified exactly on whole shingle sets, which
   gives the number of links and the edges of the final classes.

Pairs are counted where they are found and never written out one by one. Verifying all
pairs of n near copies takes a number of comparisons quadratic in n by nature; the
shuffle before it copies a set at most DEALT times, unless a group's sets together are so
large that a task could not hold a block of them.

Defined results: null counts as the empty text; a text of one to four words has one
shingle, all its words; texts without words are linked to nothing, equal ones are
copies; very long texts are compared whole; repeated rows get equal result rows; ties take the least doc_id (nulls
last); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import attach, fresh, map_slices, small, stored
from strata.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
#: MinHash values compared before each look at the posterior.
STEP = 16
#: A pair is dropped once reaching the threshold is less likely than this.
TOLERANCE = 1e-6
#: Nodes in a block of a large bucket, and of a large group in the exact step.
BUCKET_BLOCK = 4096
EXACT_BLOCK = 512
#: Blocks of a group up to which they grow in number, then in size; and shingles that a block holds at most, on average.
DEALT = 16
EXACT_SHINGLES = 2_000_000
#: Sets and columns of shingles that are multiplied at once while a block pair is verified.
EXACT_ROWS, EXACT_COLUMNS = 512, 8192
#: Copies of one text from which its rows meet their class by broadcast.
HOT_COPIES = 10_000

_MASK = (1 << 64) - 1


def text_words(text: str | None) -> list[str]:
    """Words are runs of anything but ASCII white space."""
    return (text or "").translate(_GAPS).split(" ")


_GAPS = {i: " " for i in range(9, 14)}


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_101)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's n-word shingles, sorted."""
    import xxhash

    words = [w for w in text_words(text) if w]
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i: len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits."""
    a, b = _permutations()
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(hashes), 2048):
        part = hashes[at: at + 2048, None]
        best = np.minimum(best, ((part * a + b) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return best


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: the fewest matches among n values with which a pair may stay.

    With a uniform prior the similarity given m matches of n is Beta(m+1, n-m+1);
    P(similarity >= t) is the probability of at most m successes in n+1 trials.
    """
    from math import comb

    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append(m)
    return tuple(out)


def survivors(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the paired signatures (rows of x and y) outlast the incremental comparison."""
    alive, found = np.arange(len(x)), np.zeros(len(x), dtype=np.int32)
    for k, least in enumerate(least_matches(threshold)):
        cols = slice(k * STEP, (k + 1) * STEP)
        found[alive] += (x[alive, cols] == y[alive, cols]).sum(axis=1)
        alive = alive[found[alive] >= least]
    out = np.zeros(len(x), dtype=bool)
    out[alive] = True
    return out


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _connect(sig: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Edges that connect whatever surviving pairs connect, among ``left`` (right None) or across the two.

    Nodes that are already connected are not compared again, and a node meets the
    rest in growing parts, so that copies of one text cost a few comparisons each.
    """
    edges: list[tuple[int, int]] = []
    label = np.arange(len(sig))
    pool = left if right is None else right
    for i in left:
        part = 32
        rest = pool[(label[pool] != label[i]) & (pool != i)]
        while len(rest):
            near, rest = rest[:part], rest[part:]
            part *= 4
            met = near[survivors(np.broadcast_to(sig[i], (len(near), sig.shape[1])), sig[near])]
            for j in met:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    edges.append((int(i), int(j)))
            if len(met):
                rest = rest[label[rest] != label[i]]
    return edges


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition that is sorted by ``keys``, many at a time; a group is never split."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        last = tuple(batch[k].iloc[-1] for k in keys)
        same = np.logical_and.reduce([batch[k].to_numpy() == v for k, v in zip(keys, last)])
        if same.all():
            continue
        first = int(np.argmax(same))
        whole = pd.concat([*held[:-1], batch.iloc[:first]], ignore_index=True)
        held = [batch.iloc[first:]]
        yield whole
    if held:
        yield pd.concat(held, ignore_index=True)


def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    change = np.ones(len(frame), dtype=bool)
    if len(frame) > 1:
        change[1:] = np.logical_or.reduce([frame[k].to_numpy()[1:] != frame[k].to_numpy()[:-1] for k in keys])
    return np.append(np.flatnonzero(change), len(frame))


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for batch in batches:
        rows = []
        for node, text in zip(batch["node"], batch["text"]):
            s = shingles(text)
            if len(s):
                sig = signature(s)
                bands = [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(sig[ROWS * k: ROWS * (k + 1)].tobytes(), seed=k)))) for k in range(BANDS)]
                rows.append((node, len(s), (sig & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), bands))
            else:
                rows.append((node, 0, b"", []))
        yield pd.DataFrame(rows, columns=["node", "n_shingles", "sig", "bands"])


_BUCKET = ["band", "i", "j"]


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges between nodes of a bucket (or of two of its blocks) whose pairs survive the pruning."""
    for frame in _runs(batches, _BUCKET):
        sig = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint16).reshape(len(frame), HASHES)
        node, starts, edges = frame["node"].to_numpy(), _starts(frame, _BUCKET), []
        sizes = np.diff(starts)
        little = np.repeat(sizes <= 16, sizes) & (frame["i"] == frame["j"]).to_numpy()
        group = np.repeat(np.arange(len(sizes)), sizes)
        for d in range(1, 16):  # all pairs of the small buckets at once
            at = np.flatnonzero(little[:-d] & (group[:-d] == group[d:])) if len(frame) > d else []
            if not len(at):
                break
            edges += [(at[k], at[k] + d) for k in np.flatnonzero(survivors(sig[at], sig[at + d]))]
        for k in np.flatnonzero((sizes > 16) | ~little[starts[:-1]]):
            members = np.arange(starts[k], starts[k + 1])
            i, j, block = frame["i"].iloc[starts[k]], frame["j"].iloc[starts[k]], frame["block"].to_numpy()[members]
            edges += [
                (starts[k] + a, starts[k] + b)
                for a, b in _connect(sig[members], np.flatnonzero(block == i), None if i == j else np.flatnonzero(block == j))
            ]
        yield pd.DataFrame({"a": [node[a] for a, _ in edges], "b": [node[b] for _, b in edges]})


_GROUP = ["root", "i", "j"]


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "root": batch["root"], "n": batch["n"], "shingles": batch["shingles"], "hashes": [shingles(t).tobytes() for t in batch["text"]]})


def overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The incidence of shingles that two or more sets have: set numbers, column numbers, and how many columns."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    keep = count > 1
    return row[keep[column]], (np.cumsum(keep) - 1)[column[keep[column]]], np.asarray(keep.sum())


def linked(sets: list[np.ndarray], threshold: float = THRESHOLD, split: int | None = None) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity of ``threshold`` or more, verified on whole sets.

    With ``split`` only the pairs of a set before and one from there on are compared.
    """
    n = len(sets)
    left, right = (slice(None), slice(None)) if split is None else (slice(None, split), slice(split, None))
    size = np.array([len(s) for s in sets], dtype=np.float64)
    shared = np.zeros((len(size[left]), len(size[right])), dtype=np.float64)
    row, column, columns = overlaps(sets)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(columns), EXACT_COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + EXACT_COLUMNS])
        part = np.zeros((n, min(EXACT_COLUMNS, int(columns) - at)), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        shared += part[left] @ part[right].T
    union = size[left][:, None] + size[right][None, :] - shared
    out = shared >= threshold * union - 1e-9
    out[union == 0] = False
    if split is None:
        np.fill_diagonal(out, False)
    return out


def _matches(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the linked pairs among ``left`` (right None) or across the two, EXACT_ROWS sets of each at a time; every pair once."""
    cuts = lambda x: [x[k: k + EXACT_ROWS] for k in range(0, len(x), EXACT_ROWS)]
    for k, one in enumerate(cuts(left)):
        if right is None:
            x, y = np.nonzero(np.triu(linked([sets[i] for i in one])))
            yield one[x], one[y]
        for other in cuts(left)[k + 1:] if right is None else cuts(right):
            x, y = np.nonzero(linked([sets[i] for i in one] + [sets[i] for i in other], split=len(one)))
            yield one[x], other[y]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per node its links in this block pair; and edges that span the linked nodes (rows with ``b``)."""
    for frame in _runs(batches, _GROUP):
        starts, node, block = _starts(frame, _GROUP), frame["node"].to_numpy(), frame["block"].to_numpy()
        i, j = frame["i"].to_numpy(), frame["j"].to_numpy()
        a, b, links = [], [], []
        for lo, hi in zip(starts[:-1], starts[1:]):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["hashes"].iloc[lo:hi]]
            own = block[lo:hi]
            count, parent = np.zeros(hi - lo, dtype=np.int64), np.arange(hi - lo)
            # Pairs inside a block are another task's.
            for x, y in _matches(sets, np.flatnonzero(own == i[lo]), None if i[lo] == j[lo] else np.flatnonzero(own == j[lo])):
                count += np.bincount(x, minlength=hi - lo) + np.bincount(y, minlength=hi - lo)
                for p, q in zip(x.tolist(), y.tolist()):
                    r, s = _root(parent, p), _root(parent, q)
                    if r != s:
                        parent[r] = s
                        a.append(node[lo + p]), b.append(node[lo + q]), links.append(0)
            for x in np.flatnonzero(count):
                a.append(node[lo + x]), b.append(None), links.append(int(count[x]))
        yield pd.DataFrame({"a": a, "b": b, "links": np.array(links, dtype=np.int64)})


def _dealt(df: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Rows of groups (``key``) for every pair of the group's ``blocks`` that they take part in."""
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key, "i", "j").sortWithinPartitions(key, "i", "j")


def nodes_of(documents: DataFrame) -> DataFrame:
    """doc_id, text and node of every row; the node of a text is its MD5."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, node, class_id, n_links, n_copies, representative.

    ``class_id`` is the least doc_id of the class; ``n_links`` counts the different
    texts linked to this one; ``n_copies`` the rows with the very same text.
    """
    rows = nodes_of(documents)
    # Ids travel as text through pandas, which would turn a column of numbers with a null into floats.
    made = map_slices(rows.withColumn("doc_id", F.col("doc_id").cast("string")), _sketch_rows, "doc_id string, node binary, n_shingles int, sig binary, bands array<bigint>")
    sketched = stored(made.withColumn("doc_id", F.col("doc_id").cast("long")), "sketches")
    texts = stored(sketched.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "texts")

    banded = texts.select("node", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = banded.join(crowded, "band").join(texts.select("node", "sig"), "node")
    dealt = _dealt(shared, "band", F.ceil(F.col("n") / BUCKET_BLOCK)).drop("n")
    tight = stored(dealt.mapInPandas(_candidates, "a binary, b binary").distinct(), "candidates")
    members = components(tight).join(texts.select("node", "first_id", "n_shingles"), "node")
    wanted = stored(attach(members, "root", "node", [F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")], [F.sum("n").alias("n"), F.sum("shingles").alias("shingles")]).drop("n_shingles"), "wanted")

    # Only texts in groups are read again, one row of each.
    again = rows.alias("r").join(small(wanted).alias("w"), (F.col("r.node") == F.col("w.node")) & F.col("r.doc_id").eqNullSafe(F.col("w.first_id")))
    again = again.select("r.node", "w.root", "w.n", "w.shingles", "r.text").dropDuplicates(["node"])
    sets = map_slices(again, _shingle_sets, "node binary, root binary, n long, shingles long, hashes binary")
    blocks = F.greatest(F.ceil(F.col("shingles") / EXACT_SHINGLES), F.least(F.ceil(F.col("n") / EXACT_BLOCK), F.lit(DEALT)))
    verified = stored(_dealt(sets, "root", blocks).drop("n", "shingles").mapInPandas(_verify, "a binary, b binary, links long"), "verified")
    links = verified.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    classes = components(verified.where("b is not null")).join(texts.select("node", "first_id"), "node")
    first = F.struct(F.col("first_id").isNull().alias("null_id"), "first_id", "node")
    headed = attach(classes, "root", "node", [F.min(first).alias("head")], [F.min("head").alias("head")])
    headed = headed.select("node", F.col("head.first_id").alias("head_id"), (F.col("node") == F.col("head.node")).alias("is_head"))
    labelled = texts.select("node", "first_id", "n_copies").join(headed, "node", "left").join(links, "node", "left")
    final = stored(labelled.select(
        "node", F.when(F.col("is_head").isNull(), F.col("first_id")).otherwise(F.col("head_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies",
        F.coalesce("is_head", F.lit(True)).alias("is_head"), "first_id",
    ), "classes")
    # Rows of a text with very many copies meet its class without a shuffle.
    ids, hot = sketched.select("doc_id", "node"), stored(final.where(F.col("n_copies") >= HOT_COPIES), "hot-classes")
    if hot.isEmpty():
        found = ids.join(final, "node")
    else:
        found = ids.join(small(hot.select("node")), "node", "left_anti").join(final.where(F.col("n_copies") < HOT_COPIES), "node").unionByName(ids.join(small(hot), "node"))
    return found.select("doc_id", "node", "class_id", "n_links", "n_copies", (F.col("is_head") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("representative"))


def _sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = next(_sketch(iter([batch])))
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class: the one with the least doc_id, and one of its repeats."""
    found = stored(near_duplicates(documents), "found")
    of, own_id, own = fresh(documents, "gone_node"), fresh(documents, "gone_id"), fresh(documents, "gone_own")
    counts = found.groupBy("node", "doc_id", "representative").agg(F.count("*").alias("rows"))
    gone = stored(counts.where(~F.col("representative") | (F.col("rows") > 1)).select(F.col("node").alias(of), F.col("doc_id").alias(own_id), F.col("representative").alias(own)), "gone")
    node = F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = (node == F.col(of)) & documents["doc_id"].cast("long").eqNullSafe(F.col(own_id))
    kept = documents.join(small(gone), same, "left_anti")
    repeats = gone.where(F.col(own))
    if repeats.isEmpty():
        return kept
    one = documents.join(small(repeats.select(of, own_id)), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(one)
