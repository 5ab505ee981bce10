"""Packing documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyloom.llm.bpe import IdEncoder, read_vocabulary
from tallyloom.llm.columns import as_id, in_small_batches, worker_value
from tallyloom.llm.shingles import in_groups

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Deal sizes to `ways` parts of near-equal sums; each part is a list of positions in sizes.

    The two partial partitions with the largest imbalances are merged with opposing order (the fullest part of one
    with the emptiest of the other) until one is left. A partial partition is its parts' sums in falling order and a
    tree node for each; parts that are still empty aren't stored.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    if ways == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        if len(a) < len(b):
            a, x, b, y = b, y, a, x
        meet = len(a) + len(b) - ways
        if meet > 0:  # the last `meet` parts of a take the last of b, each the emptiest the fullest
            sums, nodes = a.copy(), x.copy()
            first = len(a) - meet
            over = slice(len(b) - meet, None)
            sums[first:] += b[over][::-1]
            made = np.arange(len(left), len(left) + meet)
            left.extend(x[first:].tolist())
            right.extend(y[over][::-1].tolist())
            nodes[first:] = made
            sums, nodes = np.concatenate([sums, b[: len(b) - meet]]), np.concatenate([nodes, y[: len(b) - meet]])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == ways else 0)
        heapq.heappush(heap, (-spread, turn, sums, nodes))
        turn += 1
    parts = []
    for node in heap[0][3].tolist():
        items, stack = [], [node]
        while stack:
            n = stack.pop()
            if left[n] < 0:
                items.append(n)
            else:
                stack += [right[n], left[n]]
        parts.append(items)
    return parts + [[] for _ in range(ways - len(parts))]


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows, none above capacity; there is one more whenever capacity is exceeded."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, ways)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        ways += 1


class Packer:
    """Packs one task's documents in a stream of blocks.

    A document's full windows are sequences of their own. What is left of it is cut into pieces of `piece` tokens at
    most; `block` windows' worth of pieces is partitioned at a time, less `slack` tokens a window that move on to the
    next block (the last of them cut to measure), so that the differencing has room for its imbalance. What the last
    block can't fill becomes sequences whose lengths are powers of two, which need no padding.
    """

    def __init__(self, task: int, capacity: int = 1024, piece: int = 256, block: int = 192, slack: int = 3):
        self.capacity, self.piece, self.block, self.slack = capacity, piece, block, slack
        self.next_id = task << 33
        self.held: list[tuple] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def _emit(self, members: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in members:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        """One document's ids, its end mark included."""
        total, view = len(ids) // 4, memoryview(ids)
        full = total - total % self.capacity
        for a in range(0, full, self.capacity):
            self._emit([(doc, a, view[4 * a : 4 * (a + self.capacity)], total)])
        rest = total - full
        for a in range(full, total, self.piece):  # the last piece is shorter: short pieces even the sums out
            self.held.append((doc, a, view[4 * a : 4 * min(a + self.piece, total)], total))
        self.tokens += rest
        if self.tokens >= self.block * self.capacity:
            self._seal(self.block)

    def _seal(self, ways: int) -> None:
        """Partition the held pieces into `ways` windows; what is above that, less the slack, stays held."""
        want, got, take = ways * (self.capacity - self.slack), 0, []
        for k, (doc, start, ids, total) in enumerate(self.held):
            n = len(ids) // 4
            if got + n >= want:
                part = want - got
                take.append((doc, start, ids[: 4 * part], total))
                rest = [(doc, start + part, ids[4 * part :], total)] if part < n else []
                self.held = rest + self.held[k + 1 :]
                break
            take.append((doc, start, ids, total))
            got += n
        else:
            self.held = []
        self.tokens = sum(len(x[2]) // 4 for x in self.held)
        for part in windows_for([len(x[2]) // 4 for x in take], self.capacity):
            self._emit([take[i] for i in part])

    def finish(self) -> None:
        if ways := self.tokens // self.capacity:
            self._seal(ways)
        while self.tokens:
            size = min(self.capacity, 1 << (self.tokens.bit_length() - 1)) if self.capacity & (self.capacity - 1) == 0 else min(self.capacity, self.tokens)
            members, room = [], size
            while room:
                doc, start, ids, total = self.held.pop(0)
                n = min(room, len(ids) // 4)
                members.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    self.held.insert(0, (doc, start + n, ids[4 * n :], total))
                room -= n
            self.tokens -= size
            self._emit(members)

    def drain(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Each task packs its own input in blocks of bounded size, so there is no shuffle and nothing grows with the corpus;
    a task that is run again gives the same rows, because a sequence's number holds the number of its partition.

    Nulls: a null text counts as empty, its only token is the end mark; a null id stays null. Empty text: one piece of
    one token. Very long text: cut into full windows as it comes. Ties and repeated rows: each row is packed for
    itself. Empty table: no rows. Other columns, whatever their names, are ignored.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_value(("IdEncoder", hash(data.value)), lambda: IdEncoder(data.value))
        packer = Packer(TaskContext.get().partitionId(), capacity)
        for b in in_groups(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(doc, encoder.encode(text or "") + end)
                if len(packer.rows) > 20_000:
                    yield packer.drain()
        packer.finish()
        yield packer.drain()

    return in_small_batches(docs).select(as_id(docs, id_col), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
