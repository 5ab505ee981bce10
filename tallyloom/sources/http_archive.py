"""An archive behind HTTP: listings as a data source, snapshot documents and contents fetched by the executors.

Answers are JSON: {"items": [...], "next_cursor": ...} for listings. What goes wrong with one session is a row with a
reason; what goes wrong with a listing is an error, since a part of one would look like the whole.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from tallyloom.sources import archive

#: Where the interface begins, rows of a page, pages after which cursors count as endless.
BASE, PAGE, SNAPSHOT_PAGE, MOST_PAGES = "/api/v1", 100, 50, 10_000
TIMEOUT = 30
LISTED = "session_id string, source_agent string, snapshot_id string, completed_at string, repository string"


def document(url: str) -> dict:
    """One JSON document; HTTPError, URLError or ValueError if there is none."""
    with urlopen(url, timeout=TIMEOUT) as answer:
        return json.load(answer)


def items(url: str, most_pages: int = MOST_PAGES) -> Iterator[dict]:
    """The items of all pages of a listing; an error if cursors never end."""
    cursor = None
    for _ in range(most_pages):
        page = document(url if cursor is None else f"{url}{'&' if '?' in url else '?'}cursor={quote(cursor, safe='')}")
        if not isinstance(page.get("items"), list):
            raise ValueError(f"{url}: a page without items")
        yield from page["items"]
        cursor = page.get("next_cursor")
        if cursor is None:
            return
    raise ValueError(f"{url}: cursors after {most_pages} pages")


class SessionListing(DataSource):
    """Format session_listing: the sessions of an archive (options: address, activity_from, most_pages)."""

    @classmethod
    def name(cls) -> str:
        return "session_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


class _ListingReader(DataSourceReader):
    """One partition: each page tells where the next one begins."""

    def __init__(self, options: dict):
        self.address, self.since, self.most = options["address"], options.get("activity_from", ""), int(options.get("most_pages", MOST_PAGES))

    def read(self, partition) -> Iterator[tuple]:
        for i in items(f"{self.address}{BASE}/sessions?limit={PAGE}&activity_from={quote(self.since, safe='')}", self.most):
            last = i.get("latest_snapshot") or {}
            yield i["session_id"], i.get("source_agent"), last.get("snapshot_id"), last.get("completed_at"), last.get("repository")


def listing(spark: SparkSession, address: str, activity_from: str = "", most_pages: int = MOST_PAGES) -> DataFrame:
    """(session_id, source_agent, snapshot_id, completed_at, repository) of the sessions that were active since then."""
    spark.dataSource.register(SessionListing)
    found = spark.read.format("session_listing").option("address", address).option("activity_from", activity_from).option("most_pages", str(most_pages)).load()
    return found.withColumn("completed_at", F.try_to_timestamp("completed_at"))


def snapshots(listed: DataFrame, address: str) -> DataFrame:
    """(session_id, snapshot_id, document, reason): the snapshots of each session, newest first, PROBES at most, as JSON."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for session, latest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    page = document(f"{address}{BASE}/sessions/{quote(session, safe='')}/snapshots?limit={SNAPSHOT_PAGE}")["items"]
                    names = [latest, *(s["snapshot_id"] for s in sorted(page, key=lambda s: s["completed_at"], reverse=True) if s["snapshot_id"] != latest)]
                except (HTTPError, URLError, ValueError, KeyError) as e:
                    rows.append((session, None, None, f"no-snapshots: {type(e).__name__}"))
                    continue
                for name in names[: archive.PROBES]:
                    try:
                        rows.append((session, name, json.dumps(document(f"{address}{BASE}/snapshots/{quote(name, safe='')}")), None))
                    except (HTTPError, URLError, ValueError) as e:
                        rows.append((session, name, None, f"no-document: {type(e).__name__}"))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["session_id", "snapshot_id", "document", "reason"])

    return listed.select("session_id", "snapshot_id").mapInArrow(fetch, "session_id string, snapshot_id string, document string, reason string")


def _declared(headers, ending: str) -> str | None:
    """A header by the end of its name, whatever its prefix; sha256: before a digest doesn't count."""
    return next((v.removeprefix("sha256:") for k, v in headers.items() if k.lower().endswith(ending)), None)


def contents(wanted: DataFrame, address: str, ceiling: int = archive.MOST_BYTES) -> DataFrame:
    """wanted (source_hash, size_bytes, content_url) with content and reason: all that was declared has to hold.

    The stored bytes have to have the stored size and digest of the answer's headers, the decoded ones the listing's. No
    more than the declared size and one byte is decoded.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in batches:
            for digest, size, url in zip(*(c.to_pylist() for c in b.columns), strict=True):
                content, reason, most = None, None, min(size if size is not None else ceiling, ceiling)
                try:
                    with urlopen(address + url, timeout=TIMEOUT) as answer:
                        stored = answer.read(ceiling + 1)
                        kept, sha, kind = (_declared(answer.headers, e) for e in ("-stored-size-bytes", "-stored-sha256", "-compression"))
                    if len(stored) > ceiling or (kept is not None and len(stored) != int(kept)):
                        reason = "wrong-stored-size"
                    elif sha is not None and hashlib.sha256(stored).hexdigest() != sha:
                        reason = "wrong-stored-digest"
                    elif kind not in (None, "identity", "zstd"):
                        reason = "unknown-compression"
                    else:
                        content = archive._read(stored, most)
                        if len(content) > most:
                            reason = "over-declared-size"
                        elif hashlib.sha256(content).hexdigest() != digest:
                            reason = "wrong-digest"
                        elif size is not None and len(content) != size:
                            reason = "wrong-size"
                except (HTTPError, URLError, ValueError, io.UnsupportedOperation, zstandard.ZstdError) as e:
                    reason = f"not-fetched: {type(e).__name__}"
                yield pa.RecordBatch.from_arrays([pa.array([digest], pa.string()), pa.array([size], pa.int64()), pa.array([url], pa.string()), pa.array([None if reason else content], pa.binary()), pa.array([reason], pa.string())], names=["source_hash", "size_bytes", "content_url", "content", "reason"])

    return wanted.select("source_hash", "size_bytes", "content_url").mapInArrow(fetch, "source_hash string, size_bytes long, content_url string, content binary, reason string")


def _optional(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Rows of a small inventory; none where the archive answers 404."""
    try:
        return spark.createDataFrame(list(rows()), schema)
    except HTTPError as e:
        if e.code != 404:
            raise
        return spark.createDataFrame([], schema)


def stats(spark: SparkSession, address: str) -> DataFrame:
    """(sessions, snapshots, blobs, stored_bytes) as the archive states them; no row if it states none."""
    names = ("sessions", "snapshots", "blobs", "stored_bytes")
    return _optional(spark, lambda: [tuple(document(f"{address}{BASE}/stats")[n] for n in names)], ", ".join(f"{n} long" for n in names))


def clients(spark: SparkSession, address: str) -> DataFrame:
    """(client_id, hostname, captures) of the archive's clients; no row if it lists none."""
    return _optional(spark, lambda: [(c["client_id"], c.get("hostname"), c["capture_count"]) for c in items(f"{address}{BASE}/clients")], "client_id string, hostname string, captures long")
