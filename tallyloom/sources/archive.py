"""An archive of sessions in a folder: listing pages, snapshot documents and blobs, as Spark reads them.

    listing/*.json     {"items": [{session_id, source_agent, latest_snapshot: {snapshot_id, completed_at, repository?}}]}
    snapshots/*.json   {"snapshot_id", "session_id", "completed_at", "manifest": {...}, "artifacts": [{...}]}
    blobs/<aa>/<sha256> the artifacts' original bytes, or zstd frames of them

Nothing fails for one session's sake: what can't be used is a row with a reason.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom import constants as C

LISTING = "items array<struct<session_id:string,source_agent:string,latest_snapshot:struct<snapshot_id:string,completed_at:string,repository:string>>>"
SNAPSHOT = (
    "snapshot_id string, session_id string, completed_at string, manifest struct<session:struct<source_agent:string>,capture:struct<artifact_set_version:int,source_metadata:struct<hostname:string,utc_offset:string>>>, "
    "artifacts array<struct<artifact_id:string,logical_path:string,original_sha256:string,original_size_bytes:long,stored_size_bytes:long,content_url:string>>"
)
PATHS = {"transcript": "transcript.jsonl", "summary": "summary.md"}
#: Snapshots that are looked at for one session: the listed one and eight siblings.
PROBES = 9
#: Bytes of a blob whose size isn't declared.
MOST_BYTES = 512 << 20


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(session_id, source_agent, snapshot_id, completed_at, repository)."""
    items = spark.read.schema(LISTING).json(f"{root}/listing").select(F.explode("items").alias("i"))
    return items.select("i.session_id", "i.source_agent", "i.latest_snapshot.snapshot_id", F.try_to_timestamp("i.latest_snapshot.completed_at").alias("completed_at"), "i.latest_snapshot.repository")


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """One row per artifact of a snapshot."""
    s = spark.read.schema(SNAPSHOT).json(f"{root}/snapshots")
    return s.select(
        "snapshot_id", "session_id", F.try_to_timestamp("completed_at").alias("completed_at"), F.col("manifest.session.source_agent").alias("source_agent"),
        F.col("manifest.capture.artifact_set_version").alias("artifact_set_version"), F.col("manifest.capture.source_metadata.hostname").alias("hostname"),
        F.col("manifest.capture.source_metadata.utc_offset").alias("utc_offset"), F.explode_outer("artifacts").alias("a"),
    ).select("*", "a.artifact_id", "a.logical_path", F.regexp_replace("a.original_sha256", "^sha256:", "").alias("source_hash"), F.col("a.original_size_bytes").alias("size_bytes")).drop("a")


def usable(artifact: str):
    """Whether a snapshot's artifact row is of this kind; a transcript also needs a known harness."""
    ok = (F.col("logical_path") == PATHS[artifact]) & F.col("source_hash").rlike(r"\A[0-9a-f]{64}\z")
    return F.coalesce(ok & F.col("source_agent").isin(*C.HARNESSES) if artifact == "transcript" else ok, F.lit(False))


def sessions(spark: SparkSession, root: str, artifact: str = "transcript", since=None) -> DataFrame:
    """One row per listed session with its newest usable artifact among the listed snapshot and its siblings.

    `since` keeps sessions whose latest capture is not older. recovered tells that a sibling had to stand in; a session
    without a usable artifact has a null source_hash and a reason.
    """
    listed = listing(spark, root)
    if since is not None:
        listed = listed.filter(F.col("completed_at") >= since)
    s = snapshots(spark, root).withColumnRenamed("completed_at", "captured_at").withColumnRenamed("snapshot_id", "found_id")
    joined = listed.select("session_id", F.col("source_agent").alias("listed_agent"), "snapshot_id", F.col("completed_at").alias("archived_at"), "repository").join(s, "session_id", "left")
    w = Window.partitionBy("session_id").orderBy((F.col("found_id") == F.col("snapshot_id")).desc(), F.desc_nulls_last("captured_at"), "found_id")
    ranked = joined.withColumn("probe", F.dense_rank().over(w)).filter(F.col("probe") <= PROBES).withColumn("ok", usable(artifact))
    best = Window.partitionBy("session_id").orderBy(F.col("ok").desc(), "probe", "artifact_id")
    one = ranked.withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    hit = lambda name: F.when(F.col("ok"), F.col(name)).alias(name)
    return one.select(
        "session_id", F.coalesce("source_agent", "listed_agent").alias("source_agent"), "archived_at", "repository", "hostname", "utc_offset", "artifact_set_version",
        hit("source_hash"), hit("size_bytes"), (F.col("ok") & (F.col("found_id") != F.col("snapshot_id"))).alias("recovered"), F.when(~F.col("ok"), "no-usable-artifact").alias("reason"),
    )


def _read(content: bytes, most: int) -> bytes:
    """A blob's bytes, zstd frames decoded; one byte more than `most` at the utmost, however much a frame would give."""
    import zstandard

    if content[:4] != b"\x28\xb5\x2f\xfd":
        return content[: most + 1]
    reader, out = zstandard.ZstdDecompressor().stream_reader(content), []
    while (left := most + 1 - sum(map(len, out))) > 0 and (part := reader.read(min(left, 1 << 20))):
        out.append(part)
    return b"".join(out)


def blobs(spark: SparkSession, root: str, found: DataFrame, ceiling: int = MOST_BYTES) -> DataFrame:
    """found with content and reason: bytes are taken only if their sha256 and size are the declared ones.

    found: (source_hash, size_bytes, reason and more). Files meet it in one join; a blob is decoded up to its declared
    size (or the ceiling) and one byte more, so a frame that claims little and gives much isn't unpacked.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/blobs").select(F.regexp_extract("path", "([0-9a-f]{64})$", 1).alias("source_hash"), "content")
    joined = found.join(files, "source_hash", "left")
    schema, names = joined.select(*found.columns, "content").schema, [*found.columns, "content"]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for whole in batches:
            for at in range(whole.num_rows):  # one blob in memory beside its batch
                b = whole.slice(at, 1)
                digest, size, reason, content = (b.column(c)[0].as_py() for c in ("source_hash", "size_bytes", "reason", "content"))
                if reason is None and content is None:
                    reason = "missing"
                elif reason is None:
                    most = min(size if size is not None else ceiling, ceiling)
                    try:
                        content = _read(content, most)
                        if len(content) > most:
                            reason = "over-declared-size"
                        elif hashlib.sha256(content).hexdigest() != digest:
                            reason = "wrong-digest"
                        elif size is not None and len(content) != size:
                            reason = "wrong-size"
                    except zstandard.ZstdError:
                        reason = "damaged"
                columns = {n: b.column(n) for n in names}
                columns["reason"], columns["content"] = pa.array([reason], pa.string()), pa.array([None if reason else content], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return joined.select(*names).mapInArrow(verified, schema)


def to_fetch(found: DataFrame, held: DataFrame) -> DataFrame:
    """The sessions whose artifact is usable and not among those held (source_hash)."""
    return found.filter("source_hash is not null").join(held.select("source_hash"), "source_hash", "left_anti")


def sync_stats(found: DataFrame, held: DataFrame) -> DataFrame:
    """One row: sessions listed, hits and misses in what is held, recovered by a sibling, without a usable artifact, bytes to fetch."""
    marked = found.join(held.select("source_hash", F.lit(True).alias("held")).distinct(), "source_hash", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    usable_ = F.col("source_hash").isNotNull()
    miss = usable_ & ~F.col("held")
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return marked.agg(F.count(F.lit(1)).alias("listed"), n(F.col("held")).alias("hits"), n(miss).alias("misses"), n(F.col("recovered")).alias("recovered"), n(~usable_).alias("unusable"), F.coalesce(F.sum(F.when(miss, F.col("size_bytes"))), F.lit(0)).alias("bytes_to_fetch"))


def _optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON, or no rows where the archive doesn't have it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def stats(spark: SparkSession, root: str) -> DataFrame:
    """(sessions, bytes) as the archive states them; no row if it states none."""
    return _optional(spark, f"{root}/stats", "sessions long, bytes long")


def clients(spark: SparkSession, root: str) -> DataFrame:
    """(name, sessions) of the archive's clients; no row if it states none."""
    return _optional(spark, f"{root}/clients", "items array<struct<name:string,sessions:long>>").select(F.explode("items").alias("i")).select("i.*")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(blobs, bytes) of what is held, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/blobs").select("length")
    return files.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
