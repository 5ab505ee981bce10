"""Near-duplicate components by b-bit MinHash: banded candidates, packed low bits, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bits import bitmap_of, maybe_in
from tallyloom.llm.columns import as_id, forget_values, in_small_batches
from tallyloom.llm.op4_exact_dedup import one_each
from tallyloom.llm.shingles import GROUP, Words, in_groups, lowered, mix
from tallyloom.operators.components import components
from tallyloom.shared import cut

#: Minima that make band keys.
BANDS, ROWS = 36, 5
#: Bins of the signature that estimates: one permutation, the smallest hash of each bin, of which BITS low bits are packed.
BINS, BITS = 1024, 4
#: Members of one bucket that are compared in one block; larger buckets are split.
BLOCK = 2048
#: Members of a split bucket that are put into all of its blocks, to tie the blocks together.
PIVOTS = 32
#: Bands whose buckets make the first components; the others meet only what these leave apart.
FIRST = 8
#: Links by which one member of a block takes in others while they can still be taken in elsewhere.
CHILDREN = 16
#: Members of a bucket up to which candidates are paired by a join; in larger ones they are confirmed where they meet.
FEW = 64
#: A cell: at most about so many members outside a bucket's main component, members that they meet, and shingles of either.
OUTSIDERS, MEMBERS, CELL = 512, 1024, 1 << 20
#: Standard errors of the estimate by which it may lie below the threshold before a pair is dismissed unconfirmed.
ERRORS = 5.0

_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_NO_ID = -(1 << 63)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest of the shingles' hashes under each of BANDS * ROWS hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 512):
        v = (x[a : a + 512] ^ _XOR) * _MUL
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, for each row of minima."""
    rows = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(m), 1))
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[..., k])
    return key.view(np.int64)


def pack_bits(shingles: np.ndarray) -> bytes:
    """1 + BITS planes of BINS bits: which bins have a shingle, and the low bits of the smallest hash in each."""
    x = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    least = np.full(BINS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    np.minimum.at(least, x % np.uint64(BINS), x // np.uint64(BINS))
    full = least != 0xFFFFFFFFFFFFFFFF
    planes = np.stack([full, *(full & (least >> np.uint64(k) & np.uint64(1) == 1) for k in range(BITS))])
    return np.packbits(planes, axis=1, bitorder="little").tobytes()


def _counts(one: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins with equal bits, bins that both fill, bins that either fills."""
    k = BINS // 64
    both, unequal = one[:k] & others[..., :k], np.uint64(0)
    for p in range(1, 1 + BITS):
        unequal = unequal | (one[p * k : (p + 1) * k] ^ others[..., p * k : (p + 1) * k])
    count = lambda x: np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
    return count(both & ~unequal), count(both), np.maximum(count(one[:k] | others[..., :k]), 1)


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to others by bit counts.

    Of the bins that both fill, those with equal bits are counted, corrected for the share of the others that agree by
    chance; the bins that either fills are the whole. Sets far smaller than BINS are compared almost as they are.
    """
    equal, both, either = _counts(one, others)
    chance = 0.5**BITS
    return (equal - both * chance) / (1 - chance) / either


def possible(one: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair may reach the threshold: its estimate isn't ERRORS standard errors below it.

    The bins are a sample without replacement of the joint set, whose size follows from how many bins it fills; bins
    that both fill with different minima agree by chance in BITS bits.
    """
    equal, both, either = _counts(one, others)
    chance = 0.5**BITS
    joint = -BINS * np.log1p(-np.minimum(either, BINS - 1) / BINS)
    sampled = threshold * (1 - threshold) / either * np.maximum(1 - either / joint, 0)
    different = np.maximum(both - threshold * either, 1)
    error = np.sqrt(sampled + different * chance / (1 - chance) / either**2)
    return (equal - both * chance) / (1 - chance) / either >= threshold - ERRORS * error


def forest(ids: np.ndarray, bits: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs whose estimate is `least` or more, from well-linked members outwards.

    A member takes up to CHILDREN neighbours at first, so no member is in many links while others can take its place;
    those that only it is near to follow when the others are placed.
    """
    n = len(ids)
    if n == 2:
        return [(ids[0], ids[1])] if estimates(bits[0], bits[1:])[0] >= least else []
    near = np.stack([estimates(bits[k], bits) >= least for k in range(n)])
    found, fresh = [], np.ones(n, dtype=bool)
    for root in np.argsort(-near.sum(axis=1), kind="stable"):
        if not fresh[root]:
            continue
        queue = [root]
        fresh[root] = False
        for most in (CHILDREN, n):
            for u in queue:  # grows while it is read
                new = np.flatnonzero(near[u] & fresh)[:most]
                fresh[new] = False
                queue.extend(new)
                found += [(ids[u], ids[v]) for v in new]
    return found


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """The columns of each run of equal keys in a sorted stream."""
    held, rows = None, None
    for whole in batches:
        for start in range(0, whole.num_rows, GROUP):
            b = whole.slice(start, GROUP)
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            for k in range(b.num_rows):
                at = tuple(c[n][k] for n in keys)
                if at != held:
                    if rows:
                        yield rows
                    held, rows = at, {n: [] for n in c}
                for n in c:
                    rows[n].append(c[n][k])
    if rows:
        yield rows


def as_bits(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.uint64).reshape(len(packed), -1)


def links(found: Iterable[tuple[int, int]]) -> pa.RecordBatch:
    pairs = [(min(x), max(x)) for x in found]
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def signatures(texts: list[str | None], width: int) -> pa.RecordBatch:
    """(n, f1, f2, keys, bits) of each text: size and digest of its set, band keys, packed low bits; the last two null without shingles."""
    sets = Words([lowered(t) for t in texts]).shingle_sets(width)
    digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16) for s in sets]
    full = [k for k, s in enumerate(sets) if len(s)]
    keys = band_keys(np.array([minima(sets[k]) for k in full], dtype=np.uint32).reshape(len(full), BANDS * ROWS))
    shown = {k: (keys[at], pack_bits(sets[k])) for at, k in enumerate(full)}
    half = lambda a, z: pa.array([int.from_bytes(d[a:z], "little", signed=True) for d in digests], pa.int64())
    columns = [pa.array([shown[k][c] if k in shown else None for k in range(len(sets))], t) for c, t in enumerate((pa.list_(pa.int64()), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array(map(len, sets), pa.int64()), half(0, 8), half(8, 16), *columns], names=["n", "f1", "f2", "keys", "bits"])


def near_groups(docs: DataFrame, threshold_percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept).

    1. Equal shingle sets (a 128-bit digest of the sorted set) are one vertex, so copies never meet in pairs.
    2. Vertices that share a band key are candidates. A bitmap of fixed size over repeated keys keeps the rest out of
       the shuffle.
    3. Buckets of the first FIRST bands are cut into blocks of BLOCK members (PIVOTS members go to all blocks of their
       bucket). The packed low bits give estimates; a spanning forest of the estimates at or above the threshold, in
       which no member has many links, is confirmed on full sets, and components follow.
    4. In all buckets the members outside the bucket's main component meet all others, in cells of bounded size. Of the
       pairs in different components those whose estimate isn't ERRORS standard errors below the threshold are
       confirmed: in buckets of FEW members or less by a join with the sets, in larger ones in the cell, which gets the
       sets too, likest first until one is a link to that component. So no bucket is capped, nothing is emitted for
       pairs that are already connected, a large group's pairs are never emitted, and every link is exact.
    A pair at the threshold shares no band with probability (1 - 0.8^5)^36 < 1e-6 and is dismissed by its estimate with
    about the same.

    Nulls: a null text counts as empty; a null id is one vertex, smaller than all others (held as -2^63, so a row with
    that id comes back with null). Empty text: no shingles,
    linked with nothing. Very long text: whole set. Ties: smallest id. Repeated rows: rows of one id are one vertex if
    their texts agree. Empty table: no rows. Other columns, whatever their names, are ignored.
    """
    spark = in_small_batches(docs).sparkSession
    ident = F.coalesce(as_id(docs, id_col), F.lit(_NO_ID).cast("long"))
    base = docs.select(ident.alias("doc_id"), docs[text_col].alias("text"))
    least = threshold_percent / 100

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        for b in in_groups(batches):
            s = signatures(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), *s.columns], names=["doc_id", *s.schema.names])

    signed = cut(base.mapInArrow(sign, "doc_id long, n long, f1 long, f2 long, keys array<long>, bits binary"), "signed")
    vertices = cut(signed.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("v"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "vertices")
    buckets = cut(vertices.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    wanted = spark.sparkContext.broadcast(bitmap_of(buckets, F.col("key")))

    def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(wanted.value, dtype=np.uint8)
        for b in batches:
            keys = b.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, BANDS) if b.num_rows else np.zeros((0, BANDS), dtype=np.int64)
            row, band = np.nonzero(maybe_in(bitmap, keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, band]), pa.array(band.astype(np.int32)), b.column("v").take(pa.array(row)), b.column("n").take(pa.array(row))], names=["key", "band", "v", "n"])

    members = cut(vertices.select("v", "n", "keys").mapInArrow(shared_keys, "key long, band int, v long, n long").join(buckets, "key"), "members")
    packed = vertices.select("v", "bits")
    wanted_sets = spark.sparkContext.broadcast(bitmap_of(members, F.col("v")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_values()
        bitmap = np.frombuffer(wanted_sets.value, dtype=np.uint8)
        for b in in_groups(batches):
            b = b.filter(pa.array(maybe_in(bitmap, b.column(0).to_numpy()), pa.bool_()))
            found = [s.view(np.int64) for s in Words([lowered(t) for t in b.column(1).to_pylist()]).shingle_sets(width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["v", "shingles"])

    sets = cut(base.mapInArrow(sets_of, "v long, shingles array<long>").join(members.select("v").distinct(), "v", "left_semi"), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that reach the threshold on their full sets."""
        full = pairs.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("two")), "b")
        counted = full.select("a", "b", (F.size("one") + F.size("two")).cast("long").alias("total"), F.size(F.array_intersect("one", "two")).cast("long").alias("both"))
        return cut(counted.filter(F.col("both") * 100 >= F.lit(threshold_percent) * (F.col("total") - F.col("both"))).select("a", "b").distinct(), name)

    def collected(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        """Pairs of several runs, without those that came before."""
        held: set[tuple[int, int]] = set()
        for pairs in found:
            held.update(pairs)
            if len(held) > 50_000:
                yield links(held)
                held.clear()
        yield links(held)

    def first_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from collected(forest(np.array(r["v"]), as_bits(r["bits"]), least) for r in runs(batches, ("key", "block")) if len(r["v"]) > 1)

    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("v"), blocks).cast("int")
    pivot = (blocks > 1) & (F.pmod(F.xxhash64("v", F.lit(7)), F.col("m")) < PIVOTS)
    dealt = members.filter(F.col("band") < FIRST).withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block)))).join(packed, "v")
    first = dealt.select("key", "block", "v", "bits").repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(first_links, "a long, b long").distinct()
    sure = confirmed(first, "links")
    labels = components(sure).withColumnRenamed("vertex", "v")

    def near(r: dict[str, list]) -> Iterator[tuple[int, np.ndarray]]:
        """Each outsider of a cell with the members of other components that may be linked with it, by component and likeness."""
        ids, part, bits = np.array(r["v"]), np.array(r["component"]), as_bits(r["bits"])
        for k in np.flatnonzero(np.array(r["out"])):
            other = np.flatnonzero((part != part[k]) & possible(bits[k], bits, least))
            yield k, other[np.lexsort((ids[other], -estimates(bits[k], bits[other]), part[other]))]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from collected([(r["v"][k], r["v"][j]) for k, other in near(r) for j in other] for r in runs(batches, ("key", "chunk", "block")) if any(r["out"]))

    def settled(r: dict[str, list]) -> Iterator[tuple[int, int]]:
        sets, part = [np.array(x, dtype=np.int64) for x in r["shingles"]], r["component"]
        for k, other in near(r):
            done = None
            for j in other:
                if part[j] != done:
                    both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                    if 100 * both >= threshold_percent * (len(sets[k]) + len(sets[j]) - both):
                        done = part[j]
                        yield r["v"][k], r["v"][j]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from collected(list(settled(r)) for r in runs(batches, ("key", "chunk", "block")) if any(r["out"]))

    placed = cut(members.join(labels, "v", "left").withColumn("component", F.coalesce("component", "v")), "placed")
    sizes = placed.groupBy("key", "component").agg(F.struct(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words")).alias("of"))
    main = sizes.groupBy("key").agg(F.max(F.struct("of.size", "component", "of.words")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("of.size").alias("all"), F.sum("of.words").alias("words")).filter("parts > 1")
    main = cut(main, "main")  # else the join below can't split a bucket of very many members
    parts = lambda rows, most, words: F.greatest(F.ceil(rows / most), F.ceil(words / CELL)).cast("int")
    outer = parts(F.col("all") - F.col("top.size"), OUTSIDERS, F.col("words") - F.col("top.words"))
    split = placed.join(main.select("key", F.col("top.component").alias("main"), outer.alias("chunks"), parts(F.col("all"), MEMBERS, F.col("words")).alias("blocks")), "key")
    block, chunk = (F.pmod(F.xxhash64("v", F.lit(salt)), F.col(n)).cast("int") for salt, n in ((7, "blocks"), (11, "chunks")))
    outside = F.col("component") != F.col("main")
    cell = lambda i, j, out: F.struct(i.alias("chunk"), j.alias("block"), out.alias("out"))
    own = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: cell(i, block, outside & (i == chunk)))
    more = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != block), lambda j: cell(chunk, j, F.lit(True)))
    cells = split.withColumn("cell", F.explode(F.when(outside, F.concat(own, more)).otherwise(own))).select("key", "m", "cell.*", "v", "component").join(packed, "v")
    in_cells = lambda df: df.repartition("key", "chunk", "block").sortWithinPartitions("key", "chunk", "block")
    few = confirmed(in_cells(cells.filter(F.col("m") <= FEW)).mapInArrow(candidates, "a long, b long").distinct(), "links")
    many = cut(in_cells(cells.filter(F.col("m") > FEW).join(sets, "v")).mapInArrow(settle, "a long, b long").distinct(), "links")
    labels = components(sure.unionByName(few).unionByName(many)).withColumnRenamed("vertex", "v")
    named = vertices.select("n", "f1", "f2", "v").join(labels, "v", "left").select("n", "f1", "f2", F.coalesce("component", "v").alias("component"))
    known = signed.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    component = F.coalesce("component", "doc_id")
    shown = lambda c: F.nullif(c, F.lit(_NO_ID).cast("long"))
    return known.select(shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(component).alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, threshold_percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns, whatever their names.

    Of rows with equal id and text (less blanks) one stays, the first by its JSON. Nulls, empty and very long texts,
    ties and empty tables as in near_groups: texts without words are linked with nothing and stay.
    """
    groups = cut(near_groups(docs, threshold_percent, width, id_col, text_col).select("doc_id", "kept"), "near-kept")
    return one_each(docs, groups, id_col, text_col)
