"""The archive behind HTTP, served from a thread."""

import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
import zstandard

from tallyloom.sources import http_archive

TEXT = b"one line\n" * 50
DIGEST = hashlib.sha256(TEXT).hexdigest()


class Archive(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def answer(self, body: bytes, code: int = 200, **headers):
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        for k, v in headers.items():
            self.send_header("x-any-" + k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        url = urlsplit(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        say = lambda d, code=200: self.answer(json.dumps(d).encode(), code)
        if url.path == "/api/v1/sessions":
            at = int(q.get("cursor", 0))
            page = [{"session_id": f"s {k}", "source_agent": "claude-code", "latest_snapshot": {"snapshot_id": f"n{k}", "completed_at": "2026-08-02T00:00:00Z"}} for k in range(at, min(at + 100, 250))]
            say({"items": page, "next_cursor": str(at + 100) if at + 100 < 250 or q.get("activity_from") == "endless" else None})
        elif url.path.endswith("/snapshots"):
            k = url.path.split("%20")[1].split("/")[0]
            say({"items": [{"snapshot_id": f"old{k}", "completed_at": "2026-08-01T00:00:00Z"}]} if k != "7" else {}, 200)
        elif url.path.startswith("/api/v1/snapshots/"):
            say({"snapshot_id": url.path.rsplit("/", 1)[1]}) if "old9" not in url.path else say({}, 500)
        elif url.path == "/api/v1/stats":
            say({"sessions": 250, "snapshots": 500, "blobs": 3, "stored_bytes": 12})
        elif url.path == "/plain":
            self.answer(TEXT, stored_size_bytes=str(len(TEXT)), stored_sha256="sha256:" + DIGEST, compression="identity")
        elif url.path == "/packed":
            data = zstandard.ZstdCompressor().compress(TEXT)
            self.answer(data, stored_size_bytes=str(len(data)), stored_sha256=hashlib.sha256(data).hexdigest(), compression="zstd")
        elif url.path == "/short":
            self.answer(TEXT, stored_size_bytes="3")
        elif url.path == "/changed":
            self.answer(TEXT[:-1] + b"x", stored_sha256=DIGEST)
        else:
            say({}, 404)


@pytest.fixture(scope="module")
def address():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Archive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_listing_follows_cursors_and_refuses_endless_ones(spark, address):
    listed = http_archive.listing(spark, address, "2026-01-01T00:00:00Z")
    assert listed.count() == 250 and listed.filter("completed_at is null").isEmpty()
    with pytest.raises(Exception, match="cursors after 5 pages"):
        http_archive.listing(spark, address, "endless", 5).count()


def test_one_session_that_fails_is_a_row(spark, address):
    listed = http_archive.listing(spark, address).filter("session_id in ('s 7', 's 8', 's 9')")
    got = {(r.session_id, r.snapshot_id): (r.document is not None, r.reason) for r in http_archive.snapshots(listed, address).collect()}
    assert got == {("s 7", None): (False, "no-snapshots: KeyError"), ("s 8", "n8"): (True, None), ("s 8", "old8"): (True, None), ("s 9", "n9"): (True, None), ("s 9", "old9"): (False, "no-document: HTTPError")}


def test_contents_are_what_was_declared(spark, address):
    n = len(TEXT)
    rows = [(DIGEST, n, "/plain"), (DIGEST, n, "/packed"), (DIGEST, n - 5, "/packed"), (DIGEST, n + 1, "/plain"), (DIGEST, n, "/short"), (DIGEST, n, "/changed"), ("0" * 64, n, "/plain"), (DIGEST, n, "/gone"), (DIGEST, None, "/plain")]
    got = http_archive.contents(spark.createDataFrame(rows, "source_hash string, size_bytes long, content_url string").coalesce(1), address).collect()
    assert [r.reason for r in got] == [None, None, "over-declared-size", "wrong-size", "wrong-stored-size", "wrong-stored-digest", "wrong-digest", "not-fetched: HTTPError", None]
    assert bytes(got[1].content) == TEXT and got[2].content is None


def test_inventories_may_be_missing(spark, address):
    assert [tuple(r) for r in http_archive.stats(spark, address).collect()] == [(250, 500, 3, 12)]
    assert http_archive.clients(spark, address).count() == 0
