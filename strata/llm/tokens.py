"""Token ids of whole texts by a public word-level BPE vocabulary.

The vocabulary drops white space and never merges across it, so a text's ids are
the ids of its white-space-separated pieces in order. Pieces repeat, hence a task
remembers the ids of those it has met; what follows in the same worker doesn't.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import public_tokenizers

#: Pieces remembered by one task; the memory is emptied when full, which costs time only.
CACHE_PIECES = 200_000

#: ASCII characters that are no letters, digits or apostrophes: a run of them after a word is one piece of its own.
TRAILING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL_MARK = "<|"


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


#: White space of str.split that the vocabulary doesn't drop.
KEPT_CONTROLS = "\x1c\x1d\x1e\x1f"
_PIECE = re.compile(rf"[\S{KEPT_CONTROLS}]+")


def pieces_of(text: str) -> list[str]:
    """What stands between the vocabulary's white space."""
    return _PIECE.findall(text) if any(c in text for c in KEPT_CONTROLS) else text.split()


class PieceEncoder:
    """Little-endian 32-bit ids of pieces, as bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # The same vocabulary as byte ranks: the word-end mark becomes a byte that UTF-8 never has.
        ranks = {}
        for token, rank in vocabulary.items():
            ends = token.endswith("</w>") and token != "</w>"
            if SPECIAL_MARK not in token:
                ranks[_raw(token[:-4] if ends else token) + (b"\xff" if ends else b"")] = rank
        ranks.setdefault(b"\xff", len(vocabulary))
        self.fast = tiktoken.Encoding("word_pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _slow(self, piece: str) -> bytes:
        return _pack(self.exact.encode(piece, add_special_tokens=False).ids)

    def _learn(self, piece: str) -> bytes:
        word = piece.rstrip(TRAILING)
        if word.isalpha() and SPECIAL_MARK not in piece:
            key = word.lower() if word.isascii() else unicodedata.normalize("NFC", word)
            if not key.isascii():
                key = key.lower() if "Σ" not in key and "İ" not in key else None
            if key is not None and key.isalpha() and unicodedata.is_normalized("NFC", key):
                got = self.words.get(key)
                if got is None:
                    got = self.words[key] = _pack(self.fast(key.encode() + b"\xff"))
                run = piece[len(word):]
                if run:
                    tail = self.runs.get(run)
                    if tail is None:
                        tail = self.runs[run] = self._slow(run)
                    got += tail
                self.ids[piece] = got
                return got
        got = self.ids[piece] = self._slow(piece)
        return got

    def forget(self) -> None:
        """Empty the memory of pieces: when it is full, and at a task's end, as the worker and its encoder stay."""
        self.ids.clear()
        self.words.clear()
        self.runs.clear()

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as consecutive little-endian unsigned 32-bit values."""
        known = self.ids
        if len(known) > CACHE_PIECES:
            self.forget()
        pieces = pieces_of(text or "")
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            return b"".join([known[p] if p in known else self._learn(p) for p in pieces])


def _pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def _raw(token: str) -> bytes:
    table = _byte_of()
    return bytes(table[c] for c in token)


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies show a byte as a printable character: itself where it is one, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker, kept while the worker lives."""
    return PieceEncoder(path)
