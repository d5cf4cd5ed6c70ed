"""Packing of token sequences into fixed windows by minimum bin slack.

Documents longer than a window fill whole windows by themselves: these get their
sequence where they are made, and meet no others. What remains of each document is
one item of 1..window-1 tokens. Items are dealt to shards of a bounded
size, without their ids unless these are asked for. In a shard, windows are filled one multiset of lengths at a time: a bitset
subset-sum over the lengths still there tells which totals can be reached next to
the longest item, the total closest to the window is chosen, and its lengths are
found by walking back through the bitsets. A found multiset is repeated as often
as the counts allow.

Defined results: null and empty texts hold only the end id (one token); very long texts
are encoded and cut whole; among items of equal length the first by doc_id, start and checksum
is taken last, so ties give one result for the same shards; repeated
rows are packed once each; an empty table gives no pieces; further columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import tokens
from strata.llm.common import map_slices, stored

WINDOW = 2048
END_ID = 1
#: The vocabulary's <|endoftext|>; it fills what a sequence leaves.
PAD_ID = 49407
#: Items that one shard holds on average; it bounds what a task sorts and keeps.
SHARD_ITEMS = 8192

# Document ids travel as text through pandas, which would turn a column of numbers with a null into floats.
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, shard long, sequence_id long"
PACKED = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
IDS = ", ids binary"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (with multiplicities up to ``counts``) whose total is closest to ``room`` from below.

    Layer k of the bitset holds the totals that the first k copies-of-a-length can
    make; copies are grouped by powers of two. The layers end as soon as ``room``
    itself is reached.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    layers: list[tuple[int, int, int]] = []  # the bitset before the group, length, copies in the group
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left > 0 and not reach >> room & 1:
            take = min(group, left)
            layers.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            group *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, take in reversed(layers):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def fill_windows(lengths: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """Lists of item positions, one list a window, by minimum bin slack. Every item is in exactly one list."""
    order = np.argsort(lengths, kind="stable")
    by_length: dict[int, list[int]] = {}
    for i in order[::-1]:
        by_length.setdefault(int(lengths[i]), []).append(int(i))
    counts = {n: len(x) for n, x in by_length.items()}
    windows: list[list[int]] = []
    for longest in sorted(by_length, reverse=True):
        while counts.get(longest, 0):
            counts[longest] -= 1
            chosen = best_fill({n: c for n, c in counts.items() if c}, window - longest)
            counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(counts[n] // c for n, c in chosen.items())
            for n, c in chosen.items():
                counts[n] -= c * times
                if not counts[n]:
                    del counts[n]
            windows += [[by_length[n].pop() for n, c in chosen.items() for _ in range(c)] for _ in range(times)]
    return windows


def _pieces(path: str, window: int, shards: int, keep_ids: bool):
    """Pieces of texts. Whole windows get the next sequence of this task, whose numbers follow those of all shards; items get a shard in turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = tokens.encoder(path).encode
        end = END_ID.to_bytes(4, "little")
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        turn, sequence = task * 7919, (shards + task) << 32
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "sequence_id", *["ids"] * keep_ids]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start: 4 * (start + window)]
                    place = (-1, sequence) if len(part) == 4 * window else (turn % shards, -1)
                    sequence, turn = sequence + (place[0] < 0), turn + (place[0] >= 0)
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, *place, *[part] * keep_ids))
            yield pd.DataFrame(rows, columns=columns)
        tokens.encoder(path).forget()  # the worker lives on for other stages

    return run


def _pack_shard(window: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        lengths = items["length"].to_numpy()
        sequence = np.zeros(len(items), dtype=np.int64)
        offset = np.zeros(len(items), dtype=np.int64)
        for number, members in enumerate(fill_windows(lengths, window)):
            sequence[members] = number
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        out = items.drop(columns=["shard"])
        out["sequence_id"] = (np.int64(key[0]) << 32) + sequence
        out["offset"] = offset
        return out

    return run


def _packed(documents: DataFrame, window: int, tokenizer: str | None, shard_items: int, keep_ids: bool) -> DataFrame:
    """Pieces with their places. They are stored once, so that texts are encoded once; only items, one a document at most, are grouped."""
    shards = max(1, -(-documents.count() // shard_items))
    ids = IDS if keep_ids else ""
    rows = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = stored(map_slices(rows, _pieces(tokenizer or tokens.default_path(), window, shards, keep_ids), PIECES + ids), "pieces")
    whole = made.where("shard < 0").drop("shard").withColumn("offset", F.lit(0).cast("long"))
    items = made.where("shard >= 0").groupBy("shard").applyInPandas(_pack_shard(window), PACKED + ids)
    return whole.unionByName(items).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_ids(documents: DataFrame, window: int = WINDOW, tokenizer: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Pieces of all ``documents`` (doc_id, text) with their ids (little-endian, 32 bits each) and places in sequences of at most ``window`` tokens.

    Sequence ids are unique across shards. A shard holds at most about ``shard_items`` items of less than a window.
    """
    return _packed(documents, window, tokenizer, shard_items, True)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = PAD_ID) -> DataFrame:
    """sequence_id, n_tokens and ids (always ``window`` of them, padded behind) of what ``pack_ids`` gave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, parts = None, []

        def whole() -> tuple:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            return held, len(ids), np.append(ids, np.full(window - len(ids), pad_id)).astype(np.int32)

        for batch in batches:
            rows = []
            for sequence, ids in zip(batch["sequence_id"].tolist(), batch["ids"]):
                if parts and sequence != held:
                    rows.append(whole())
                    parts = []
                held = sequence
                parts.append(bytes(ids))
            yield pd.DataFrame(rows, columns=["sequence_id", "n_tokens", "ids"])
        if parts:
            yield pd.DataFrame([whole()], columns=["sequence_id", "n_tokens", "ids"])

    placed = pieces.select("sequence_id", "offset", "ids").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    return placed.mapInPandas(run, "sequence_id long, n_tokens long, ids array<int>")


def pack(documents: DataFrame, window: int = WINDOW, tokenizer: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The packed pieces with a checksum in place of their ids."""
    return _packed(documents, window, tokenizer, shard_items, False)
