"""Rank-file vocabularies and the encoding of whole texts in Python workers."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import regex
import tiktoken

#: Splits a text before the merges (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and numbers up to U+02C1; texts of such characters (but U+001C to U+001F, which the engines' `\\s` differ on) are split by the faster of two engines.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02c1", "0-9\xb2\xb3\xb9\xbc-\xbe"
_FAST_PATTERN = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")
#: The first id that the vocabulary leaves free; the separator after each document.
END_OF_DOCUMENT = 50256


@dataclass(frozen=True)
class Vocabulary:
    """pieces[id] are the bytes of an id; ids are ranks."""

    pieces: tuple[bytes, ...]

    @staticmethod
    def load(path: str) -> "Vocabulary":
        """Read a rank file: base64 piece and rank in each line, ranks from 0 without a gap."""
        with open(path, "rb") as f:
            ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, f)}
        return Vocabulary(tuple(ranks[i] for i in range(len(ranks))))

    def ranks(self) -> dict[bytes, int]:
        return {p: i for i, p in enumerate(self.pieces)}


def word_splitter() -> Callable[[str], list[str]]:
    """A function that splits a text to the pattern's matches."""
    slow, fast, odd = regex.compile(PATTERN).findall, re.compile(_FAST_PATTERN).findall, re.compile("[^\x00-\x1b\x20-\u02c1]").search
    return lambda text: slow(text) if odd(text) else fast(text)


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the adjacent pair of least rank, the leftmost of equals, until none has a rank. n log n for a word of n bytes."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    start, after, before = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[start[i] : end[after[i]]])) is not None:
                heapq.heappush(queue, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[start[before[i]] : end[i]])) is not None:
            heapq.heappush(queue, (r, before[i], end[i]))
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes whole texts with tiktoken.

    Its pattern engine gives up on very long runs of white space; texts that hold one are split and merged here.
    """

    LONG_RUN = regex.compile(r"\s{10000}")

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranks()
        self.whole = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self.find = word_splitter()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text (null: none) as little-endian 16-bit integers."""
        if not text:
            return b""
        if len(text) >= 10000 and self.LONG_RUN.search(text):
            return b"".join([array("H", merge_word(w.encode("utf-8", "replace"), self.ranks)).tobytes() for w in self.find(text)])
        return array("H", self.whole(text)).tobytes()


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker and vocabulary, as building one takes a while."""
    key = hash(vocabulary.pieces[-1]) ^ len(vocabulary.pieces)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]
