"""Words of many texts at once, their 64-bit hashes and word shingles: arrays only, nothing is remembered between calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tallyloom.llm.columns import BLANKS, give_back

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS.encode())] = True
#: The first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of the longest word that is hashed eight bytes at a time.
LONGEST = 64
#: Texts, and bytes of text, that are worked on at a time (a longer text is one group).
GROUP, GROUP_BYTES = 512, 1 << 20
#: Low bits that tell a word's place beside its hash while minimisers are chosen.
_PLACE = np.uint64((1 << 20) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x ^= x >> np.uint64(33)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(33))


def in_groups(batches: Iterator[pa.RecordBatch], text: int | str = 1, rows: int = GROUP, size_in_bytes: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, so many or about so many bytes of text at a time: memory doesn't follow the size of Arrow's batches."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(size, before + size_in_bytes))))
            yield b.slice(at, to - at)
            at = to
    give_back()


class Words:
    """The words of some texts (bytes): data, where each word starts and ends in it, and the first word of each text."""

    def __init__(self, texts: list[bytes]):
        joined = b" ".join([b"", *texts, b"       "])
        self.data = joined
        self.bytes = np.frombuffer(joined, dtype=np.uint8)
        edge = np.diff(_BLANK[self.bytes].view(np.int8))
        self.start = np.flatnonzero(edge == -1) + 1
        self.end = np.flatnonzero(edge == 1) + 1
        places = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, places)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: words of eight bytes or fewer with one length never collide."""
        length = self.end - self.start
        h = mix(length.astype(np.uint64) * _ODD[5])
        if not len(h):
            return h
        eight = np.ndarray((len(self.bytes) - 7,), dtype="<u8", buffer=self.bytes, strides=(1,))
        h = mix(h ^ (eight[self.start] & _FIRST[np.minimum(length, 8)]))
        live, done = np.flatnonzero((length > 8) & (length <= LONGEST)), 8
        while len(live):
            h[live] = mix(h[live] * _ODD[6] ^ (eight[self.start[live] + done] & _FIRST[np.minimum(length[live] - done, 8)]))
            done += 8
            live = live[length[live] > done]
        for k in np.flatnonzero(length > LONGEST):
            h[k] = xxhash.xxh64_intdigest(self.data[self.start[k] : self.end[k]])
        return h

    def grams(self, h: np.ndarray, width: int) -> np.ndarray:
        """A 64-bit hash of the width words from each word on (also across texts: the caller takes those inside one)."""
        total = np.full(max(len(h) - width + 1, 0), width, dtype=np.uint64)
        for k in range(width):
            total = (total ^ h[k : len(total) + k]) * _ODD[k % 8]
            total ^= total >> np.uint64(29)
        return mix(total)

    def shingle_sets(self, width: int) -> list[np.ndarray]:
        """Of each text the sorted distinct shingles; with fewer words than width the whole sequence is one; without words none."""
        h = self.hashes()
        all_grams, out = self.grams(h, width), []
        for a, z in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            n = z - a
            out.append(np.unique(all_grams[a : z - width + 1]) if n >= width else self.grams(h[a:z], n) if n else np.zeros(0, dtype=np.uint64))
        return out


def minimisers(words: Words, window: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of windows, minimiser) of each maximal run of windows of one text with one minimiser.

    A window's minimiser is the leftmost of its smallest hashes of width words, so equal windows have equal ones.
    """
    span = window - min(width, window) + 1
    grams = words.grams(words.hashes(), min(width, window))
    n = len(grams) - span + 1
    if n < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    least, reach = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64) & _PLACE, 1
    while reach < span:
        step = min(reach, span - reach)
        least, reach = np.minimum(least[:-step], least[step:]), reach + step
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.arange(n)
    at = at[at + window <= words.first[1:][text[:n]]]
    place = at + ((least[at] - at.astype(np.uint64)) & _PLACE).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[at[1:]] != text[at[:-1]])])) if len(at) else at
    return text[at[begins]], at[begins], np.diff(np.append(begins, len(at))), grams[place[begins]].view(np.int64)


def lowered(text: str | None) -> bytes:
    """A text in UTF-8 with A-Z in lower case."""
    return (text or "").encode().lower()
