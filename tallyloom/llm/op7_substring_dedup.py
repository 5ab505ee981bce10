"""Removal of repeated passages: super-k-mers meet in the bucket of their minimiser, where sorting finds equal windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bits import bitmap_of, maybe_in
from tallyloom.llm.columns import as_id, forget_values, in_small_batches
from tallyloom.llm.shingles import Words, in_groups, minimisers
from tallyloom.shared import cut

#: Words of a minimiser.
MINIMISER = 4
#: Super-k-mers of one bucket that are sorted at a time; what is first among them goes on to the next time.
CHUNK = 20_000
#: Documents, and bytes of their texts, whose super-k-mers are made, and of which equal ones are put together, at a time.
GROUP, GROUP_BYTES = 1000, 4 << 20
#: Super-k-mers of a minimiser beyond which each of their windows travels by its own hash.
HOT = 10_000
#: Bits of the map of minimisers that occur twice or more (16 MiB).
BITS = 1 << 27
_NO_ID = -(1 << 63)


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed super-k-mer."""
    ends, at = [], 0
    for w in packed.split(b" "):
        at += len(w) + 1
        ends.append(at)
    starts = [0, *ends]
    return [packed[starts[k] : ends[k + window - 1] - 1] for k in range(len(ends) - window + 1)]


class Bucket:
    """One minimiser's super-k-mers in order of (doc, start): marks the windows that also start earlier."""

    def __init__(self, window: int):
        self.window = window
        self.first: dict[bytes, tuple[int, int]] = {}
        self.strings: dict[bytes, tuple[int, int]] = {}
        self.fresh: list[tuple[bytes, int, int]] = []
        self.marks: list[tuple[int, int, int]] = []

    def add(self, packed: bytes, doc: int, start: int, count: int) -> None:
        seen = self.strings.get(packed)
        if seen is None:
            self.strings[packed] = doc, start
            self.fresh.append((packed, doc, start))
            if len(self.fresh) >= CHUNK:
                self.sort()
        elif seen != (doc, start):
            self.marks.append((doc, start, start + count - 1 + self.window))

    def sort(self) -> None:
        """Sort the fresh windows; of equal ones all but the first are marked, unless an earlier chunk had it."""
        if len(self.fresh) + len(self.first) > 1:
            rows = sorted((w, doc, start + k) for packed, doc, start in self.fresh for k, w in enumerate(windows_of(packed, self.window)))
            again, held, origin = [], None, None
            for w, doc, at in rows:
                if w != held:
                    held, origin = w, self.first.setdefault(w, (doc, at))
                if origin != (doc, at):
                    again.append((doc, at))
            again.sort()
            for doc, at in again:
                if self.marks and self.marks[-1][0] == doc and self.marks[-1][1] <= at <= self.marks[-1][2] - self.window + 1:
                    self.marks[-1] = doc, self.marks[-1][1], at + self.window
                else:
                    self.marks.append((doc, at, at + self.window))
        elif self.fresh:
            packed, doc, start = self.fresh[0]
            for k, w in enumerate(windows_of(packed, self.window)):
                self.first[w] = doc, start + k
        self.fresh = []

    def finish(self) -> list[tuple[int, int, int]]:
        if len(self.fresh) > 1 or self.first:
            self.sort()
        return self.marks


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def left_over(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    """The words that no range covers."""
    if not ranges:
        return words
    keep = np.ones(len(words), dtype=bool)
    for a, z in ranges:
        keep[a:z] = False
    return [words[k] for k in np.flatnonzero(keep)]


def repeated_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ranges): for each document with removed words, the ranges of words [from, to) that its windows cover.

    A window is `window` consecutive words. One that also starts earlier (smaller id, or earlier in its document) is
    marked. Consecutive windows with one minimiser travel as one packed string to the minimiser's bucket. A first pass
    counts minimisers with partial aggregation; a bitmap of fixed size over those that occur twice or more keeps
    the other super-k-mers out of the shuffle. The windows of a minimiser with more than HOT super-k-mers (a second
    bitmap tells) travel one by one to the bucket of their own hash, so a bucket holds HOT strings or one window. Equal
    strings of GROUP documents are one row (the later ones are marked at once and dealt by document), so a passage that
    a third of all rows share reaches its bucket once a group. A bucket is read as a sorted stream and sorted CHUNK strings at a time.
    """
    spark = in_small_batches(docs).sparkSession
    base = docs.select(F.coalesce(as_id(docs, id_col), F.lit(_NO_ID).cast("long")).alias("doc_id"), docs[text_col].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for b in in_groups(batches, 1, GROUP, GROUP_BYTES):
            key, n = np.unique(minimisers(Words([(t or "").encode() for t in b.column(1).to_pylist()]), window, MINIMISER)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    often = cut(base.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"), "minimisers")
    wanted = spark.sparkContext.broadcast(bitmap_of(often, F.col("key"), BITS))
    hot = spark.sparkContext.broadcast(bitmap_of(often.filter(F.col("n") > HOT), F.col("key")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        bitmap, split = np.frombuffer(wanted.value, dtype=np.uint8), np.frombuffer(hot.value, dtype=np.uint8)
        for b in in_groups(batches, 1, GROUP, GROUP_BYTES):
            docs, texts = b.column(0).to_pylist(), [b" ".join(words_of(t)) for t in b.column(1).to_pylist()]
            words = Words(texts)
            text, first, number, key = minimisers(words, window, MINIMISER)
            chosen = np.flatnonzero(maybe_in(bitmap, key))
            text, first, number, key = text[chosen], first[chosen], number[chosen], key[chosen]
            apart = maybe_in(split, key)
            if apart.any():  # one row for each window, whose key follows from its words
                times = np.where(apart, number, 1)
                row = np.repeat(np.arange(len(key)), times)
                step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                text, first, number, key, apart = text[row], first[row] + step, np.where(apart, 1, number)[row], key[row], apart[row]
            data, from_, to = words.data, words.start[first].tolist(), words.end[first + number + window - 2].tolist()
            start = (first - words.first[text]).tolist()
            held: dict[bytes, tuple[int, int, int]] = {}
            out = []
            for t, a, n, k, alone, x, y in zip(text.tolist(), start, number.tolist(), key.tolist(), apart.tolist(), from_, to, strict=True):
                packed, doc = data[x:y], docs[t]
                was = held.get(packed)
                if was is None:
                    held[packed] = doc, a, xxhash.xxh3_64_intdigest(packed) - (1 << 63) if alone else k
                elif (doc, a) < was[:2]:
                    held[packed] = doc, a, was[2]
                    out.append((was[0], was[0], was[1], n, None))
                elif (doc, a) != was[:2]:
                    out.append((doc, doc, a, n, None))  # is marked already: dealt by document, not to the bucket
            out += [(key, doc, a, 0, packed) for packed, (doc, a, key) in held.items()]
            for at in range(0, len(out), 50_000):
                c = list(zip(*out[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c[:4]] + [pa.array(c[4], pa.binary())], names=["key", "doc_id", "start", "n", "packed"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            c = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["doc_id", "a", "z"])

        held, bucket, found = None, None, []
        for b in batches:
            for key, doc, start, n, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != held:
                    if bucket:
                        found += bucket.finish()
                    held, bucket = key, Bucket(window)
                if packed is None:
                    found.append((doc, start, start + n - 1 + window))
                else:
                    bucket.add(packed, doc, start, packed.count(b" ") + 2 - window)
            if len(found) > 20_000:
                yield rows(found)
                found = []
        if bucket:
            found += bucket.finish()
        yield rows(found)

    marks = (
        base.mapInArrow(send, "key long, doc_id long, start long, n long, packed binary")
        .repartition("key")
        .sortWithinPartitions("key", "doc_id", "start")
        .mapInArrow(sort, "doc_id long, a long, z long")
    )
    return cut(marks.groupBy("doc_id").agg(F.collect_set(F.struct("a", "z")).alias("ranges")), "passages")


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_words, n_removed, kept_sha256, kept_text).

    kept_text is what is left: the kept words joined by one space.

    Only documents whose id may be among those with removed words (a bitmap of fixed size tells) are shuffled.

    Nulls: a null text has no words; a null id is one document, before all others (held as -2^63, so a row with that id
    comes back with null). Empty or short text: no window,
    nothing removed. Very long text: whole. Ties: equal windows at the same place of rows with one id (repeated rows)
    are one window, so such rows are treated alike; rows of one id are one document. Empty table: no rows. Other
    columns, whatever their names, are ignored.
    """
    ranges = repeated_passages(docs, window, id_col, text_col)
    base = docs.select(F.coalesce(as_id(docs, id_col), F.lit(_NO_ID).cast("long")).alias("doc_id"), docs[text_col].alias("text"))
    hit = docs.sparkSession.sparkContext.broadcast(bitmap_of(ranges, F.col("doc_id")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def shown(ids: pa.Array, texts: list, found: list) -> pa.RecordBatch:
        words = [words_of(t) for t in texts]
        kept = [left_over(w, [(r["a"], r["z"]) for r in f or ()]) for w, f in zip(words, found, strict=True)]
        body = [b" ".join(k) for k in kept]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(map(len, words), pa.int64()), pa.array([len(w) - len(k) for w, k in zip(words, kept, strict=True)], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in body], pa.string()), pa.array([x.decode() for x in body], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    def chosen(b: pa.RecordBatch, inside: bool) -> pa.RecordBatch:
        found = maybe_in(np.frombuffer(hit.value, dtype=np.uint8), b.column(0).to_numpy())
        return b.filter(pa.array(found == inside, pa.bool_()))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches):
            b = chosen(b, False)
            yield shown(b.column(0), b.column(1).to_pylist(), [None] * b.num_rows)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield chosen(b, True)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches):
            yield shown(b.column("doc_id"), b.column("text").to_pylist(), b.column("ranges").to_pylist())

    other = base.mapInArrow(touched, "doc_id long, text string").join(ranges, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(reduce, schema)
    all_rows = base.mapInArrow(untouched, schema).unionByName(other)
    return all_rows.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID).cast("long")))
