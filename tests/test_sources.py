"""Transcripts, summaries, the archive folder, streams and reports."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import metrics, rules
from tallyloom.plans import queries, reports
from tallyloom.sources import archive, summaries, transcripts
from tallyloom.streaming import sessions as streams


def lines(*docs):
    return "\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs).encode()


CLAUDE = lines(
    {"type": "user", "timestamp": "2026-08-01T09:00:00.000Z", "message": {"content": "please do"}},
    {"type": "assistant", "timestamp": "2026-08-01T09:01:00Z", "message": {"id": "m", "model": "claude-opus-5", "usage": {"input_tokens": 3, "output_tokens": 4, "cache_creation": {"ephemeral_5m_input_tokens": 5}}, "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"command": "git commit"}}]}},
    "not json",
    {"type": "user", "timestamp": "2026-08-01T09:02:00Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": "no"}]}},
    {"type": "system", "subtype": "compact_boundary", "timestamp": "2026-08-01T09:03:00Z", "compactMetadata": {"preTokens": "12"}},
    {"type": "system", "subtype": "local_command_stdout", "compactMetadata": {"preTokens": 12}},
)
COPILOT = lines(
    {"type": "user.message", "timestamp": 1, "data": {"content": "x"}},
    {"type": "tool.execution_start", "data": {"toolCallId": "c", "toolName": "shell", "arguments": {"command": "ls"}}},
    {"type": "tool.execution_complete", "data": {"toolCallId": "c", "success": False}},
    {"type": "skill.invoked", "data": {"name": " "}},
    {"type": "session.compaction_complete", "data": {"success": False, "preCompactionTokens": 9}},
)
CODEX = lines({"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "x"}]}}, *[{"type": "response_item", "payload": {"type": "local_shell_call", "call_id": "a", "action": {"command": ["make", "x"]}}}] * 6, {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "a", "output": "y"}})


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [("a", "claude-code", 2, CLAUDE), ("b", "copilot", 2, COPILOT), ("c", "codex-cli", 2, CODEX), ("d", "other", 2, b"{}"), ("e", "claude", 9, b"{}"), ("f", "claude", 2, None), ("g", "claude", 2, b"")]
    return spark.createDataFrame([(*r, dt.datetime(2026, 8, 2), None, None, None) for r in rows], "session_id string, source_agent string, artifact_set_version int, content binary, archived_at timestamp, repository string, hostname string, utc_offset string")


def test_three_harnesses_become_events(blobs):
    e = transcripts.typed_events(blobs).cache()
    m = {r.session_id: r for r in metrics.session_metrics(e, blobs.drop("content", "artifact_set_version")).collect()}
    assert (m["a"].user_requests, m["a"].assistant_messages, m["a"].tool_activities, m["a"].attempts, m["a"].errors, m["a"].commits, m["a"].active_ms, m["a"].compactions_completed) == (1, 1, 2, 1, 1, 1, 180_000, 1)
    assert (m["b"].attempts, m["b"].errors, m["b"].skills, m["b"].compactions_failed, m["b"].active_ms) == (1, 1, 0, 1, None)
    assert (m["c"].busiest_runs, m["c"].attempts, m["c"].compactions_completed) == (6, 0, None)
    v = {(r.session_id, r.rule): r.fired for r in rules.verdicts(metrics.session_metrics(e, blobs.drop("content", "artifact_set_version"))).collect()}
    assert v["c", "retry-loop"] is True and v["a", "unreviewed-ship"] is True and v["b", "unreviewed-ship"] is None
    assert e.filter("malformed").count() == 1 and e.filter("session_id in ('d', 'e', 'f', 'g')").count() == 0
    u = transcripts.usage_records(e).filter("session_id = 'a'").collect()
    assert [(r.message_id, r.output, r.cache_5m) for r in u] == [("m", 4, 5)]
    assert {tuple(r) for r in transcripts.unreadable(blobs).collect()} == {("d", "unknown-harness"), ("e", "unsupported-version"), ("f", "no-content")}


SUMMARY = "---\nid: x\nrepository: team/repo\ntags: [a, 'b']\nsource_hash: q\nsource_prefix_hash: q\n---\n# Title\n\n## Goal\nDo it\nwell.\n\n## Decisions\n- one\n  more\n- two\n\n## Open items\n- three\n"


def test_summaries(spark):
    got = summaries.parse(SUMMARY)
    assert (got["title"], got["goal"], got["tags"], got["decisions"], got["open_items"], got["reason"]) == ("Title", "Do it well.", ["a", "b"], ["one more", "two"], ["three"], None)
    assert summaries.parse("hello")["reason"] == "not-an-archive" and summaries.parse(None)["reason"] == "not-an-archive"
    assert summaries.parse(SUMMARY.replace("hash: q\n---", "hash: r\n---"))["reason"] == "inconsistent"
    assert summaries.parse("---\nsummary_placeholder: true\n---\n# T")["reason"] == "placeholder"
    d = spark.createDataFrame([("h", None, SUMMARY.encode())], "source_hash string, archived_at timestamp, content binary")
    assert summaries.summaries(d).first().decisions == ["one more", "two"]


def test_archive_folder(spark, tmp_path):
    import zstandard

    digest = hashlib.sha256(CLAUDE).hexdigest()
    bad = "0" * 64
    for name in ("listing", "snapshots", f"blobs/{digest[:2]}", "blobs/00"):
        (tmp_path / name).mkdir(parents=True)
    item = lambda s, snap: {"session_id": s, "source_agent": "claude-code", "latest_snapshot": {"snapshot_id": snap, "completed_at": "2026-08-02T00:00:00Z", "repository": "r"}}
    (tmp_path / "listing/1.json").write_text(json.dumps({"items": [item("a", "s1"), item("b", "s3"), item("c", "none")]}))
    snap = lambda i, s, at, artifacts: json.dumps({"snapshot_id": i, "session_id": s, "completed_at": at, "manifest": {"session": {"source_agent": "claude-code"}, "capture": {"artifact_set_version": 2, "source_metadata": {"hostname": "h"}}}, "artifacts": artifacts})
    art = lambda h, n: [{"artifact_id": "1", "logical_path": "transcript.jsonl", "original_sha256": f"sha256:{h}", "original_size_bytes": n}]
    (tmp_path / "snapshots/x.json").write_text("\n".join([snap("s1", "a", "2026-08-02T00:00:00Z", []), snap("s2", "a", "2026-08-01T00:00:00Z", art(digest, len(CLAUDE))), snap("s3", "b", "2026-08-02T00:00:00Z", art(bad, 3))]))
    (tmp_path / f"blobs/{digest[:2]}/{digest}").write_bytes(zstandard.ZstdCompressor().compress(CLAUDE))
    (tmp_path / f"blobs/00/{bad}").write_bytes(b"abc")
    found = archive.sessions(spark, str(tmp_path))
    got = {r.session_id: r for r in archive.blobs(spark, str(tmp_path), found).collect()}
    assert got["a"].recovered and bytes(got["a"].content) == CLAUDE and got["a"].reason is None
    assert got["b"].reason == "wrong-digest" and got["b"].content is None and got["c"].reason == "no-usable-artifact"
    assert archive.inventory(spark, str(tmp_path)).first().blobs == 2


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2026, 8, 1, 9, 0)
    rows = [("s", t0 + dt.timedelta(minutes=m)) for m in (0, 15, 30, 46, 50)] + [("end", t0 + dt.timedelta(days=2))]
    spark.createDataFrame(rows, "session_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.sitting_windows(stream).writeStream.format("memory").queryName("sittings").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.records, r.starts_at) for r in spark.table("sittings").collect()) == [(2, rows[3][1]), (3, t0)]
    listing = spark.createDataFrame([("a", "1", t0), ("a", "2", t0 + dt.timedelta(days=1)), ("b", "3", None)], "session_id string, snapshot_id string, completed_at timestamp")
    listing.coalesce(1).write.parquet(str(tmp_path / "listing"))
    q = streams.keep_latest(spark.readStream.schema(listing.schema).parquet(str(tmp_path / "listing")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    done = streams.published(listing, str(tmp_path / "out"))
    assert {tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / f"out/v={done}")).collect()} == {("a", "2"), ("b", "3")}


def test_reports(spark):
    m = queries._sided(spark, "/root/testdata/sf0.001").cache()
    now = dt.datetime(2024, 2, 1, tzinfo=dt.UTC)
    doc = reports.report(m, now, "10d")
    assert json.loads(reports.to_json(doc))["schema_version"] == 1 and doc["data"]["totals"]["sessions"] == m.filter("side = 'reported'").count()
    assert sum(a["sessions"] for a in doc["data"]["agents"]) == doc["data"]["totals"]["sessions"]
    assert "## Lanes" in reports.report_markdown(doc)
    assert "4137a6c61b13" in reports.catalogue()
    page = reports.catalogue_html()
    assert "<h2>Redaction</h2>" in page and page.count("<table>") == page.count("</table>") == 4 and "&lt;synthetic&gt;" not in page
    payload = reports.dashboard({"10d": m}, m, now)
    assert sum(x["sessions"] for x in payload["data"]["timeline"]) == m.count() == sum(x["sessions"] for x in payload["data"]["heatmap"])
    from tallyloom.operators import cost

    lines_ = queries._lines(spark, "/root/testdata/sf0.001").cache()
    priced = reports.cost_report(lines_, cost.price_table(spark), now, "12w")
    assert priced["data"]["all"]["dollars"] == pytest.approx(sum(r["dollars"] for r in priced["data"]["by_model"]))
    assert "List price" in reports.cost_markdown(priced)


def test_text_reports(spark):
    from tallyloom.operators import repetition
    from tallyloom.sources import bindings

    now, sf = dt.datetime(2026, 8, 1, tzinfo=dt.UTC), "/root/testdata/sf0.001"
    s = bindings.summaries(spark, sf).cache()
    doc = reports.ask_report(s, queries.QUESTION, now)
    assert len(doc["data"]["hits"]) == min(10, doc["data"]["total_matches"]) and "matches" in reports.ask_markdown(doc) + "matches"
    assert reports.ask_report(s, "the", now)["data"]["hits"] == []
    stand = reports.standup_report(s, now, "7d")
    assert sum(r["sessions"] for r in stand["data"]["repositories"]) + sum(g["sessions"] for g in stand["data"]["gaps"]) == s.count()
    assert "## " in reports.standup_markdown(stand)
    text = "please always run the linter before you commit any of the changes and then open the"
    rows = [(1, "all", "a", 1, f"{text} request", None, "r"), (2, "all", "b", 1, f"{text} issue", None, "r"), (3, "all", "b", 2, "something else that nobody ever asked for again in this archive", None, "r")]
    m = repetition.clusterable(spark.createDataFrame(rows, "id long, pool string, session_id string, locator long, text string, ts timestamp, repository string"))
    c = repetition.clusters(m)
    talks = repetition.conversations(m, c)
    found = repetition.repetitions(c, talks)
    found_flows = repetition.flows(c, talks, found)
    after = spark.createDataFrame([("r", 4, 1, 1)], "repository string, messages long, after_error long, place long")
    doc = reports.repetition_report("flows", found, found_flows, repetition.coverage(m), now, friction=after, unexamined=repetition.unexamined(m.withColumn("pool", F.lit("all"))), instances=repetition.flow_instances(c, talks, found, found_flows))
    assert doc["data"]["friction"][0]["after_error"] == 1 and doc["data"]["unexamined"] == [] and "## Requests after a failure" in reports.repetition_markdown(doc)
    assert [(x["occurrences"], x["conversations"], x["representative"]) for x in doc["data"]["clusters"]] == [(2, 2, f"{text} request")]
    assert "2×" in reports.repetition_markdown(doc)


def test_the_dashboard_has_all_sections(spark):
    from tallyloom.operators import cost
    from tallyloom.sources import bindings

    sf, now = "/root/testdata/sf0.001", dt.datetime(2024, 2, 1, tzinfo=dt.UTC)
    e = bindings.coached_events(spark, sf).cache()
    m = metrics.session_metrics(e, bindings.sessions(e), bindings.IDLE_GAP_MS).withColumn("side", F.lit("reported")).cache()
    payload = reports.dashboard({"all": m}, m, now, bindings.MARATHON_MS, e, queries._lines(spark, sf), cost.price_table(spark), bindings.summaries(spark, sf))
    data = payload["data"]
    assert {"windows", "scopes", "scope_findings", "timeline", "heatmap", "devices", "landing", "anchors", "cost", "standup"} <= set(data) and payload["provenance"]["sessions"] == m.count()
    fired = {f["rule"]: f["fired"] for f in data["windows"]["all"]["findings"]}
    assert sum(f["sessions"] for f in data["scope_findings"]) == sum(fired.values())
    assert {s["rule"] for s in data["windows"]["all"]["stated"]} == {k for k, n in fired.items() if n}
    text = reports.report_markdown(reports.report(m, now, "all", bindings.MARATHON_MS, metrics.tool_tally(e)))
    assert "### Retry loop" in text and "one command run" in text


def test_secrets_are_scrubbed_before_the_cut(spark):
    """A token that lies across the end of a snippet or an excerpt is found whole."""
    from tallyloom.operators import summaries as S
    from tallyloom.sources import bindings

    token = "ghp_" + "a1B2" * 10
    goal = "decided " + "x" * 180 + " " + token + " tail"
    rows = bindings.summaries(spark, "/root/testdata/sf0.001").limit(1).withColumns({"goal": F.lit(goal), "title": F.lit("t"), "placeholder": F.lit(False), "decisions": F.array().cast("array<string>")})
    hit = S.ask(rows, "what was decided").first()
    assert "[REDACTED:" in hit.snippet and "ghp_" not in hit.snippet
    lines_ = spark.createDataFrame([("s", 1, 1, "y" * 60 + goal)], "session_id string, locator long, line_no long, line string")
    assert "ghp_" not in S.verbatim(lines_, "decided").first().excerpt


def test_the_standup_has_no_cap(spark):
    rows = [(f"h{k}", f"title {k}", [f"decision {k}"]) for k in range(30)]
    s = spark.createDataFrame(rows, "source_hash string, title string, decisions array<string>").selectExpr(
        "source_hash", "timestamp'2026-08-01 00:00:00' as archived_at", "title", "'r' as repository", "array() as tags", "'g' as goal", "decisions", "cast(array() as array<string>) as open_items", "false as placeholder"
    )
    d = reports.standup_report(s, dt.datetime(2026, 8, 2, tzinfo=dt.UTC), "7d")["data"]
    assert len(d["sessions"]) == len(d["decisions"]) == 30


def test_blobs_beyond_their_declared_size_are_not_unpacked():
    import zstandard

    bomb = zstandard.ZstdCompressor().compress(bytes(50_000_000))
    assert len(archive._read(bomb, 1000)) == 1001


def test_routes():
    from tallyloom.functions.web import route

    digest = "a" * 64
    assert route("GET", "/")[0] == "page" and route("POST", "/")[0] == "method-not-allowed" and route("GET", "/x")[0] == "not-found"
    assert route("GET", f"/api/evidence/{digest}/12")[1] == {"source_hash": digest, "locator": 12} and route("GET", f"/api/evidence/{digest}/012")[0] == "not-found"
    assert route("GET", "/api/ask?q=a%20b&limit=3")[1] == {"question": "a b", "limit": 3} and route("GET", "/api/ask?q=&limit=3")[0] == route("GET", "/api/ask?q=x&limit=0")[0] == "bad-request"


def test_a_failed_refresh_keeps_the_last_body(spark, tmp_path):
    """State lies in the folder, so it outlives the process that failed."""
    path = str(tmp_path / "payload")

    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        streams.refresh_once(spark, path, 0, fails)
    assert streams.refresh_once(spark, path, 0, lambda: "good")["stale_since"] is None
    first = streams.refresh_once(spark, path, 1, fails)
    again = streams.refresh_once(spark, path, 2, fails)
    assert first["stale_since"] and again["stale_since"] == first["stale_since"] and streams.refresh_once(spark, path, 1, lambda: "late")["body_of"] == again["body_of"] == 0
    streams.refresh_once(spark, path, 3, lambda: "new")
    assert sorted((r.generation, r.body, r.stale_since is None) for r in streams.generations(spark, path).collect()) == [(0, "good", True), (1, "good", False), (2, "good", False), (3, "new", True)]
