"""Byte-level byte pair encoding with a public vocabulary, merging by a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import base64
import hashlib
import os

import regex

#: Splits a text before merging; a fixed value that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bound of a vocabulary file that is sent to every executor.
MOST_BYTES = 64 << 20


def default_path() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str | None = None) -> bytes:
    path = path or default_path()
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes texts; remembers the ids of up to ``most_words`` pieces of text that it has met."""

    def __init__(self, vocabulary: bytes, most_words: int = 200_000, longest_word: int = 64):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.find = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}
        self.most_words, self.longest_word = most_words, longest_word

    def merge(self, word: bytes) -> list[int]:
        """Ids of one piece. Leaf i of the tree holds rank * width + i of the pair that starts at byte i, or infinity.

        The root is thus the leftmost of the lowest-ranked pairs. A merge changes three leaves: its own, the one to its left
        and the one it swallows.
        """
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        width = 1 << (n - 1).bit_length()
        never = (1 << 62)
        tree = [never] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                tree[width + i] = rank * width + i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        end = list(range(1, n + 1))  # where the part that starts at i ends
        left = list(range(-1, n - 1))  # where the part before it starts

        def put(i: int, key: int) -> None:
            k = width + i
            tree[k] = key
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        def key(i: int) -> int:
            middle = end[i]
            if middle >= n:
                return never
            rank = ranks.get(word[i : end[middle]])
            return never if rank is None else rank * width + i

        while tree[1] != never:
            i = tree[1] % width
            gone = end[i]
            end[i] = end[gone]
            if end[i] < n:
                left[end[i]] = i
            put(gone, never)
            put(i, key(i))
            if left[i] >= 0:
                put(left[i], key(left[i]))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : end[i]]])
            i = end[i]
        return ids

    def word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            ids = self.merge(word.encode())
            if len(word) <= self.longest_word:
                if len(self.words) >= self.most_words:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known, extend = self.words.get, out.extend
        for w in self.find(text):
            extend(known(w) or self.word(w))
        return out

    def count(self, text: str | None) -> int:
        known = self.words.get
        return sum(len(known(w) or self.word(w)) for w in self.find(text)) if text else 0


_encoders: dict[bytes, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """The encoder of this Python worker for a vocabulary; built once, kept while the worker lives."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def text_of(raw: bytes | None) -> str | None:
    """Bytes that are no UTF-8 become U+FFFD."""
    return None if raw is None else raw.decode("utf-8", "replace")
