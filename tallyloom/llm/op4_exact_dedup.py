"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bits import bitmap_of, bitmap_table, maybe_in, with_hits
from tallyloom.llm.columns import BLANKS, as_id, fresh, in_small_batches, worker_value
from tallyloom.llm.shingles import in_groups
from tallyloom.shared import cut

#: Bytes of a chunk.
CHUNK = 1 << 16
#: A prime below 2^31, so that a product of two residues fits 64 bits.
PRIME = (1 << 31) - 1
#: One base for each of the four residues of a fingerprint.
BASES = (1_000_003, 722_135_891, 1_402_024_253, 48_271_117)
#: Code points of text beyond which a document's chunks travel as rows, to be hashed by several workers.
LONG = 1 << 22

_DROP = BLANKS.encode()


class Polynomials:
    """Fingerprints of byte strings: for each base B the value of b0*B^(n-1) + ... + b(n-1) modulo PRIME."""

    def __init__(self, prime: int = PRIME, bases: tuple[int, ...] = BASES):
        self.prime = prime
        power = np.ones((len(bases), CHUNK + 1), dtype=np.int64)
        for k in range(CHUNK):
            power[:, k + 1] = power[:, k] * np.array(bases) % prime
        self.power = power
        self.falling = np.ascontiguousarray(power[:, CHUNK - 1 :: -1])  # B^(CHUNK-1) ... B^0
        self.bases = bases

    def chunk(self, data: bytes) -> np.ndarray:
        """Residues of one chunk, by itself: chunks can be hashed in parallel."""
        b = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
        return self.falling[:, CHUNK - len(b) :] @ b % self.prime

    def shift(self, length: int) -> np.ndarray:
        """B^length."""
        return self.power[:, length] if length <= CHUNK else np.array([pow(b, length, self.prime) for b in self.bases], dtype=np.int64)

    def combine(self, left: np.ndarray, right: np.ndarray, right_length: int) -> np.ndarray:
        """Residues of a concatenation: the left part moves up by the length of the right one. Associative."""
        return (left * self.shift(right_length) + right) % self.prime

    def whole(self, data: bytes) -> np.ndarray:
        """Residues of a byte string of any length."""
        out = np.zeros(len(self.bases), dtype=np.int64)
        for a in range(0, len(data), CHUNK):
            part = data[a : a + CHUNK]
            out = self.combine(out, self.chunk(part), len(part))
        return out

    def fold(self, residues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two longs for each row of residues."""
        half = len(self.bases) // 2
        pair = lambda x: x[:, 0] if x.shape[1] == 1 else x[:, 0] << 31 | x[:, 1]
        return pair(residues[:, :half]), pair(residues[:, half:])

    def keys(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Two longs for each byte string."""
        return self.fold(np.array([self.whole(b) for b in bodies], dtype=np.int64).reshape(len(bodies), len(self.bases)))


def chunks_of(text: str, points: int = CHUNK) -> Iterator[bytes]:
    """body_of a text in pieces of so many code points, less their blanks: a long body is never made whole."""
    for a in range(0, len(text), points):
        if part := body_of(text[a : a + points]):
            yield part


def body_of(text: str | None) -> bytes:
    """The text without its blanks, in UTF-8."""
    return (text or "").encode().translate(None, _DROP)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prime: int = PRIME, bases: tuple[int, ...] = BASES, long_text: int = LONG) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after deleting blanks. Of equal texts the row with the most code points stays, then
    the smallest id.

    1. Every text gets a fingerprint. Of one longer than long_text the chunks become rows that many workers hash; a chunk's
       residues move up by the length of what follows it, and their sum is the text's, by partial aggregation.
    2. Fingerprints are grouped by partial aggregation. A bitmap of fixed size tells which ids may be in a group of two
       or more; only those texts are read again and streamed as chunks through an aggregation by fingerprint, number
       and bytes of the chunk. Equal chunks meet before the shuffle, so a group of any size sends each task's distinct
       chunks, and no text is held whole beside another.
    3. A group in which some chunk has two contents isn't one: its rows are grouped by digest, so the result never
       depends on the fingerprint.

    Nulls: a null text counts as empty; a null id is an id of its own, smaller than others. Empty text: all empty texts
    are equal. Very long text: memory in proportion to one text. Ties: smallest id. Repeated rows: counted each, and
    marked kept each if their id is the one that stays (keep_first takes one of them). Empty table: no rows. Other
    columns are ignored.
    """
    spark = in_small_batches(docs).sparkSession
    base = docs.select(as_id(docs, id_col), docs[text_col].alias("text"))
    make = lambda: worker_value(("Polynomials", prime, bases), lambda: Polynomials(prime, bases))
    residues = [f"r{k}" for k in range(len(bases))]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * len(bases)]
    names = ["row", "doc_id", "points", "size", "sha", "number", "after", "chunk", *residues]

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, row = make(), TaskContext.get().partitionId() << 40
        as_rows = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], names=names)
        for b in in_groups(batches):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text, row = text or "", row + 1
                if len(text) <= long_text:
                    body = body_of(text)
                    out.append((row, doc, len(text), len(body), hashlib.sha256(body).hexdigest(), None, None, None, *p.whole(body).tolist()))
                    continue
                sha, size = hashlib.sha256(), sum(map(len, chunks_of(text)))
                after = size
                for number, chunk in enumerate(chunks_of(text)):
                    sha.update(chunk)
                    after -= len(chunk)
                    out.append((row, doc, len(text), size, None, number, after, chunk, *[None] * len(bases)))
                    if len(out) >= 64:
                        yield as_rows(out)
                        out = []
                out.append((row, doc, len(text), size, sha.hexdigest(), None, None, None, *[None] * len(bases)))
            yield as_rows(out)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = make()
        for b in batches:
            r = np.array([p.shift(after) * p.whole(chunk) % prime for after, chunk in zip(b.column("after").to_pylist(), b.column("chunk").to_pylist(), strict=True)], dtype=np.int64).reshape(b.num_rows, len(bases))
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(r[:, k]) for k in range(len(bases)))], names=["row", *residues])

    schema = "row long, doc_id long, points long, size long, sha string, number long, after long, chunk binary, " + ", ".join(f"{r} long" for r in residues)
    read = cut(base.mapInArrow(fingerprints, schema), "fingerprints")
    parts = read.filter("chunk is not null").select("row", "number", "after", "chunk").repartition("row", "number")
    summed = parts.mapInArrow(hashed, "row long, " + ", ".join(f"{r} long" for r in residues)).groupBy("row").agg(*(F.pmod(F.sum(r), F.lit(prime)).alias(r) for r in residues))
    whole = read.filter(f"chunk is null and {residues[0]} is not null").select("doc_id", "points", "size", "sha", *residues)
    long = read.filter(f"chunk is null and {residues[0]} is null").select("row", "doc_id", "points", "size", "sha").join(summed, "row", "left").fillna(0, residues).select(*whole.columns)
    half = len(bases) // 2
    pair = lambda r: F.col(r[0]) if len(r) == 1 else F.shiftleft(r[0], 31).bitwiseOR(F.col(r[1]))
    one = whole.unionByName(long).select("doc_id", "points", "size", "sha", pair(residues[:half]).alias("f1"), pair(residues[half:]).alias("f2"))

    key = ["f1", "f2", "size"]
    best = F.min(F.struct((-F.col("points")).alias("less"), "doc_id")).alias("best")
    groups = cut(one.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), best, F.min("sha").alias("sha")), "exact-groups")
    multi = groups.filter("n > 1")
    listed = spark.sparkContext.broadcast(bitmap_of(multi, F.col("f1")))

    def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(listed.value, dtype=np.uint8)
        for b in batches:
            yield b.filter(pa.array(maybe_in(bitmap, b.column("f1").to_numpy()), pa.bool_()))

    members = cut(one.mapInArrow(members_of, "doc_id long, points long, size long, sha string, f1 long, f2 long").join(multi.select(*key, F.col("best.doc_id").alias("first_id"), "n"), key), "exact-members")
    ids = spark.sparkContext.broadcast(bitmap_of(members, F.coalesce("doc_id", F.lit(0))))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, bitmap = make(), np.frombuffer(ids.value, dtype=np.uint8)
        for b in in_groups(batches):
            texts = b.filter(pa.array(maybe_in(bitmap, b.column(0).fill_null(0).to_numpy()), pa.bool_())).column(1).to_pylist()
            for text in texts:
                mark, size = np.zeros(len(bases), dtype=np.int64), 0
                for chunk in chunks_of(text or ""):
                    mark, size = p.combine(mark, p.whole(chunk), len(chunk)), size + len(chunk)
                f1, f2 = (int(x[0]) for x in p.fold(mark.reshape(1, -1)))
                for number, chunk in enumerate(chunks_of(text or "", CHUNK)):
                    yield f1, f2, size, number, chunk

    def as_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, out, held = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], [], 0
        as_rows = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=[*key, "number", "chunk"])
        for row in streamed(batches):
            out.append(row)
            held += len(row[4])
            if held > LONG:
                yield as_rows()
                out, held = [], 0
        yield as_rows()

    contents = base.mapInArrow(as_chunks, "f1 long, f2 long, size long, number long, chunk binary").groupBy(*key, "number", "chunk").agg(F.count(F.lit(1)).alias("times"))
    mixed = cut(contents.groupBy(*key, "number").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select(*key).distinct().join(multi.select(*key), key, "left_semi"), "exact-mixed")
    apart = members.join(mixed, key)
    own = apart.groupBy(*key, "sha").agg(F.count(F.lit(1)).alias("group_size"), best)
    result = lambda df, keep, size: df.select(
        "doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return (
        result(groups.filter("n = 1").withColumn("doc_id", F.col("best.doc_id")), F.col("doc_id"), F.lit(1))
        .unionByName(result(members.join(mixed, key, "left_anti"), F.col("first_id"), F.col("n")))
        .unionByName(result(apart.join(own, [*key, "sha"]), F.col("best.doc_id"), F.col("group_size")))
    )


def body_sha(text) -> Column:
    """text_sha256 of exact_groups."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256)


def one_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that groups keeps, of those with one id and text (less blanks) one: the first by its JSON.

    groups: (doc_id, kept) or (doc_id, kept, text_sha256), a row for each row of docs. Rows whose id is there once and
    kept pass without a shuffle: a bitmap of fixed size marks the other ids, and only rows that it marks are joined.
    """
    by = [c for c in ("doc_id", "text_sha256") if c in groups.columns]
    touched = cut(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("kept")).filter("n > 1 or not kept").select("doc_id"), "touched")
    hit, stays, sha, other, *named = fresh(docs, "hit", "stays", "sha", "row", *(f"kept_{c}" for c in by))
    ident = F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long"))
    marked = with_hits(docs, ident, bitmap_table(touched, F.coalesce("doc_id", F.lit(0).cast("long"))), hit)
    doubtful = marked.filter(hit).drop(hit).withColumns({stays: F.col(id_col).cast("long"), sha: body_sha(F.col(text_col))})
    same_id = lambda right: F.col(stays).eqNullSafe(F.col(right))
    spared = doubtful.join(touched.select(F.col("doc_id").alias(named[0])), same_id(named[0]), "left_anti")
    wanted = groups.filter("kept").join(touched.select(F.col("doc_id").alias("again")), F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
    wanted = wanted.select(*(F.col(c).alias(n) for c, n in zip(by, named, strict=True))).distinct()
    met = doubtful.join(wanted, same_id(named[0]) & (F.col(sha) == F.col(named[1]) if len(by) > 1 else F.lit(True)), "left_semi")
    first = met.groupBy(stays, sha).agg(F.min_by(F.struct(*docs.columns), F.struct(-F.length(F.coalesce(F.col(text_col), F.lit(""))), F.to_json(F.struct(*docs.columns)))).alias(other)).select(f"{other}.*")
    return marked.filter(~F.col(hit)).select(*docs.columns).unionByName(spared.select(*docs.columns)).unionByName(first)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of equal texts, with all its columns: also of rows that repeat the id that stays.

    Nulls, empty and very long texts, ties and empty tables as in exact_groups; repeated rows: one stays, the first by
    its JSON if other columns differ. Other columns, whatever their names, are kept.
    """
    groups = cut(exact_groups(docs, id_col, text_col).select("doc_id", "kept", "text_sha256"), "exact-kept")
    return one_each(docs, groups, id_col, text_col)
