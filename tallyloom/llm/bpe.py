"""Byte-pair vocabularies: a heap-and-linked-list merge counter and an encoder for identifiers.

Both work on whole texts. What a pre-token comes to is remembered in a memory of two generations: when the young one
holds `capacity` pieces, it becomes the old one, whose unused pieces are then forgotten. So frequent pieces stay and
memory is bounded whatever the vocabulary of the corpus is.
"""

from __future__ import annotations

import heapq
import json
import re

#: Fixed value: the pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same pattern for texts in ASCII, in Python's own re (with re.ASCII).
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
#: The same pattern without its look-ahead, for texts in which no two characters of white space meet.
SINGLE_PATTERN = PATTERN.replace(r"\s+(?!\S)|\s+", r"\s")

#: An upper bound for a vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20


def read_vocabulary(path: str) -> bytes:
    """The file's bytes; refuses one that is too large to broadcast."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Memory(dict):
    """Pieces and what was made of them; __missing__ looks among the old ones, then makes."""

    def __init__(self, make, capacity: int, longest: int = 64):
        super().__init__()
        self.make, self.capacity, self.longest, self.old = make, capacity, longest, {}

    def __missing__(self, piece):
        if (found := self.old.get(piece, self)) is self:
            found = self.make(piece)
            if len(piece) > self.longest:
                return found
        if len(self) >= self.capacity:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class MergeCounter:
    """Counts the tokens of a byte-level BPE without making identifiers.

    The pre-tokens of a text are merged by popping the lowest-ranked adjacent pair from a heap; neighbours are a
    doubly linked list, so one merge costs O(log n) and one pre-token of n bytes O(n log n), however long it is.
    """

    def __init__(self, vocabulary: bytes, capacity: int = 600_000):
        import regex

        doc = json.loads(vocabulary)
        ids = doc["model"]["vocab"]
        self.first = [ids[c] for c in byte_alphabet()]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(doc["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[ids[a] << 24 | ids[b]] = rank
            self.merged.append(ids[a + b])
        special = sorted((t["content"] for t in doc.get("added_tokens", []) if t["content"]), key=len, reverse=True)
        self.special = special
        self.cut_special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.any_pieces, self.ascii_pieces = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self.tokens = Memory(self._token, capacity)

    def merges(self, data: bytes) -> int:
        """How many merges turn the bytes of one pre-token into its tokens."""
        n = len(data)
        if n < 2:
            return 0
        rank, merged, first, push, pop = self.rank.get, self.merged, self.first, heapq.heappush, heapq.heappop
        symbol = [first[b] for b in data]
        heap = []
        for i in range(n - 1):
            if (r := rank(symbol[i] << 24 | symbol[i + 1])) is not None:
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if j >= n or symbol[i] < 0 or rank(symbol[i] << 24 | symbol[j]) != r:
                continue  # one of the two has gone into another merge since
            symbol[i] = new = merged[r]
            symbol[j] = -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := rank(new << 24 | symbol[k])) is not None:
                    push(heap, q << 32 | i)
            if (h := before[i]) >= 0 and (q := rank(symbol[h] << 24 | new)) is not None:
                push(heap, q << 32 | h)
        return done

    def _token(self, pretoken: str) -> int:
        data = pretoken.encode()
        return len(data) - self.merges(data)

    def _ordinary(self, text: str) -> int:
        pieces = self.ascii_pieces if text.isascii() else self.any_pieces
        return sum(map(self.tokens.__getitem__, pieces(text)))

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token."""
        if not any(x in text for x in self.special):
            return self._ordinary(text)
        parts = self.cut_special.split(text)
        return len(parts) - 1 + sum(map(self._ordinary, parts))


class IdEncoder:
    """Identifiers of a byte-level BPE file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    The merges are run by tiktoken's core over the same vocabulary, several times as fast as the tokenizers library;
    the identifiers are the same (tests hold them against that library), special strings included.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken

        doc = json.loads(vocabulary)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        special = {t["content"]: t["id"] for t in doc.get("added_tokens", [])}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in doc["model"]["vocab"].items() if t not in special}
        self.allowed = set(special)
        self.general, self.single = (
            tiktoken.Encoding("vocabulary", pat_str=p, mergeable_ranks=ranks, special_tokens=special)._core_bpe.encode_to_tiktoken_buffer
            for p in (PATTERN, SINGLE_PATTERN)
        )
        self.white_space_meets = re.compile(r"\s\s").search

    def encode(self, text: str) -> bytes:
        """The ids of one whole text."""
        return bytes((self.general if self.white_space_meets(text) else self.single)(text, self.allowed))
