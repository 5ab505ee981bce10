"""Queries over an archive folder that is written from the driver's tables: listings, snapshots, blobs, transcripts, summaries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.registry import query
from tallyloom.shared import table_path
from tallyloom.sources import archive, summaries, transcripts
from tallyloom.sources import bindings as B

_AGENTS = "'claude-code', 'copilot-cli', 'codex-cli', 'other'"


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A customer is a session, an order one of its snapshots.

    Orders of status P hold no transcript, one in five of the others states no proper digest. One customer in seven
    isn't listed, and one in eleven names a latest snapshot that isn't there.
    """
    root = table_path(spark, "archive")
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    shown = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    agent = F.expr(f"element_at(array({_AGENTS}), cast(o_custkey % 4 + 1 as int))")
    digest = F.when(F.col("o_orderkey") % 5 == 0, "sha256:none").otherwise(F.concat(F.lit("sha256:"), F.sha2(F.col("o_orderkey").cast("string"), 256)))
    path = F.when(F.col("o_orderstatus") == "P", "notes.txt").otherwise("transcript.jsonl")
    artifact = F.struct(F.lit("1").alias("artifact_id"), path.alias("logical_path"), digest.alias("original_sha256"), (F.col("o_orderkey") % 1000).cast("long").alias("original_size_bytes"))
    name = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    session = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    orders.select(
        name.alias("snapshot_id"), session.alias("session_id"), shown.alias("completed_at"),
        F.struct(F.struct(agent.alias("source_agent")).alias("session"), F.struct(F.lit(2).alias("artifact_set_version"), F.struct(F.concat(F.lit("host-"), (F.col("o_custkey") % 3).cast("string")).alias("hostname")).alias("source_metadata")).alias("capture")).alias("manifest"),
        F.array(artifact).alias("artifacts"),
    ).write.json(f"{root}/snapshots")
    latest = orders.groupBy("o_custkey").agg(F.max(F.struct("at", "o_orderkey")).alias("l")).select("o_custkey", "l.*").filter("o_custkey % 7 <> 0")
    shown_id = F.when(F.col("o_custkey") % 11 == 0, F.lit("gone")).otherwise(name)
    item = F.struct(session.alias("session_id"), agent.alias("source_agent"), F.struct(shown_id.alias("snapshot_id"), shown.alias("completed_at"), F.concat(F.lit("repo-"), (F.col("o_custkey") % 5).cast("string")).alias("repository")).alias("latest_snapshot"))
    latest.groupBy(F.pmod(F.xxhash64("o_custkey"), F.lit(64)).alias("page")).agg(F.collect_list(item).alias("items")).select("items").write.json(f"{root}/listing")
    return root


_FOLDER_SQL = f"""
    o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS TIMESTAMP) AS at_, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS found_id, [{_AGENTS}][CAST(o_custkey % 4 + 1 AS INTEGER)] AS agent FROM orders),
    l AS (SELECT o_custkey, max(at_) AS archived_at, CASE WHEN o_custkey % 11 = 0 THEN 'gone' ELSE lpad(CAST(arg_max(o_orderkey, (at_, o_orderkey)) AS VARCHAR), 12, '0') END AS listed FROM o WHERE o_custkey % 7 <> 0 GROUP BY o_custkey),
    p AS (SELECT l.*, found_id, agent, o_orderkey, row_number() OVER (PARTITION BY l.o_custkey ORDER BY found_id = listed DESC, at_ DESC, found_id) AS probe,
                 o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AND agent <> 'other' AS ok FROM l JOIN o USING (o_custkey)),
    c AS (SELECT * FROM p WHERE probe <= 9 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY ok DESC, probe) = 1),
    f AS (SELECT 's' || o_custkey AS session_id, agent AS source_agent, CAST(archived_at AS VARCHAR)[:19] AS archived_at, 'repo-' || (o_custkey % 5) AS repository, 'host-' || (o_custkey % 3) AS hostname,
                 CASE WHEN ok THEN sha256(CAST(o_orderkey AS VARCHAR)) END AS source_hash, CASE WHEN ok THEN o_orderkey % 1000 END AS size_bytes, ok AND found_id <> listed AS recovered, CASE WHEN NOT ok THEN 'no-usable-artifact' END AS reason FROM c)"""


@query(f"WITH {_FOLDER_SQL} SELECT * FROM f")
def src11_sessions(spark, sf_dir):
    """SRC1 to SRC3, SRC10, SRC11, FIL14, FUN18, FUN19: listed sessions with their newest usable artifact, siblings standing in."""
    found = archive.sessions(spark, _folder(spark, sf_dir))
    return found.select("session_id", "source_agent", F.date_format("archived_at", "yyyy-MM-dd HH:mm:ss").alias("archived_at"), "repository", "hostname", "source_hash", "size_bytes", "recovered", "reason")


@query(f"WITH {_FOLDER_SQL} SELECT session_id, source_hash FROM f WHERE archived_at >= '2001-06-01 00:00:00'")
def src1_since(spark, sf_dir):
    """The listing from a time of activity on."""
    found = archive.sessions(spark, _folder(spark, sf_dir), since=F.lit("2001-06-01 00:00:00").cast("timestamp"))
    return found.select("session_id", "source_hash")


_HELD_SQL = "h AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS source_hash, o_orderkey % 1000 AS size_bytes FROM o WHERE o_orderkey % 3 = 0)"


def _held(spark, sf_dir: str) -> DataFrame:
    o = B.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0")
    return o.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("source_hash"), (F.col("o_orderkey") % 1000).cast("long").alias("size_bytes"))


@query(f"""WITH {_FOLDER_SQL}, {_HELD_SQL}
    SELECT session_id, source_hash FROM f WHERE source_hash IS NOT NULL AND source_hash NOT IN (SELECT source_hash FROM h)""")
def joi10_to_fetch(spark, sf_dir):
    """SRC8, SRC9 and JOI10: what isn't held yet and has to be fetched."""
    return archive.to_fetch(archive.sessions(spark, _folder(spark, sf_dir)), _held(spark, sf_dir)).select("session_id", "source_hash")


@query(f"""WITH {_FOLDER_SQL}, {_HELD_SQL}, x AS (SELECT f.*, h.source_hash IS NOT NULL AS held FROM f LEFT JOIN h ON h.source_hash = f.source_hash)
    SELECT count(*) AS listed, sum(held::INTEGER)::BIGINT AS hits, sum((source_hash IS NOT NULL AND NOT held)::INTEGER)::BIGINT AS misses, sum(recovered::INTEGER)::BIGINT AS recovered,
           sum((source_hash IS NULL)::INTEGER)::BIGINT AS unusable, sum(CASE WHEN source_hash IS NOT NULL AND NOT held THEN size_bytes ELSE 0 END)::BIGINT AS bytes_to_fetch FROM x""")
def agg37_sync(spark, sf_dir):
    """What a synchronisation comes to."""
    return archive.sync_stats(archive.sessions(spark, _folder(spark, sf_dir)), _held(spark, sf_dir))


@query("SELECT 'clients' AS what, count(*) AS rows, sum(n_nationkey)::BIGINT AS sessions FROM nation UNION ALL SELECT 'stats', 1, (SELECT count(*) FROM orders) UNION ALL SELECT 'absent', 0, NULL")
def src4_inventory(spark, sf_dir):
    """Statistics and clients of an archive; one that has none of them gives no rows."""
    root = table_path(spark, "inventory")
    n = B.table(spark, sf_dir, "nation")
    n.groupBy().agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("sessions"))).alias("items")).write.json(f"{root}/clients")
    B.table(spark, sf_dir, "orders").groupBy().agg(F.count(F.lit(1)).alias("sessions"), F.lit(3).cast("long").alias("bytes")).write.json(f"{root}/stats")
    count = lambda what, df: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("rows"), F.sum("sessions").alias("sessions"))
    return count("clients", archive.clients(spark, root)).unionByName(count("stats", archive.stats(spark, root))).unionByName(count("absent", archive.clients(spark, f"{root}/none")))


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(data)
    out.close()


def _blobs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """The 25 nations' comments as blobs, by key modulo 6: plain, compressed, of another size than declared, missing, damaged, larger than declared."""
    import zstandard

    root = table_path(spark, "blobs")
    rows = []
    for r in B.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # a table of 25 rows
        content = f"{r.n_name} {r.n_nationkey}".encode() * 40
        digest, kind, size = hashlib.sha256(content).hexdigest(), r.n_nationkey % 6, len(content)
        stored = {1: zstandard.ZstdCompressor().compress(content), 4: content[:-1], 5: zstandard.ZstdCompressor().compress(content)}.get(kind, content)
        size += {2: 1, 5: -10}.get(kind, 0)
        if kind != 3:
            _write(spark, f"{root}/blobs/{digest[:2]}/{digest}", stored)
        rows.append((f"s{r.n_nationkey}", digest, size, None))
    return root, spark.createDataFrame(rows, "session_id string, source_hash string, size_bytes long, reason string")


_BLOBS_SQL = "b AS (SELECT n_nationkey AS k, repeat(n_name || ' ' || n_nationkey, 40) AS content FROM nation)"


@query(f"""WITH {_BLOBS_SQL} SELECT 's' || k AS session_id, CASE k % 6 WHEN 2 THEN 'wrong-size' WHEN 3 THEN 'missing' WHEN 4 THEN 'wrong-digest' WHEN 5 THEN 'over-declared-size' END AS reason,
        CASE WHEN k % 6 < 2 THEN sha256(content) END AS content FROM b""")
def src5_blobs(spark, sf_dir):
    """SRC5: contents that are what was declared, and why the others aren't taken."""
    root, found = _blobs(spark, sf_dir)
    return archive.blobs(spark, root, found).select("session_id", "reason", F.sha2("content", 256).alias("content"))


@query(f"WITH {_BLOBS_SQL}, s AS (SELECT count(*) AS blobs FROM b WHERE k % 6 <> 3) SELECT blobs, true AS has_bytes FROM s")
def agg36_usage(spark, sf_dir):
    root, _ = _blobs(spark, sf_dir)
    return archive.inventory(spark, root).select("blobs", (F.col("bytes") > 0).alias("has_bytes"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(n AS BIGINT) AS record, CASE WHEN role <> 'system' THEN role END AS kind, CASE WHEN role <> 'system' THEN sha256(text) END AS text FROM t""")
def src6_transcripts(spark, sf_dir):
    """conversations as transcripts, one JSON line a turn, read back as typed events."""
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    c = B.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    blobs = c.select(F.col("conv_id").cast("string").alias("session_id"), F.lit("claude-code").alias("source_agent"), F.lit(2).alias("artifact_set_version"), F.col("content").cast("binary").alias("content"))
    return transcripts.typed_events(blobs).select("session_id", "record", "kind", F.sha2("text", 256).alias("text"))


@query("""WITH d AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
    SELECT sha256(CAST(doc_id AS VARCHAR)) AS source_hash, CASE WHEN doc_id % 13 = 0 THEN 'placeholder' WHEN doc_id % 17 = 0 THEN 'inconsistent' WHEN doc_id % 19 = 0 THEN 'not-an-archive' END AS reason,
           CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 THEN 'T ' || doc_id END AS title,
           CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 THEN sha256(array_to_string(w[1:20], ' ')) END AS goal,
           CASE WHEN doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 THEN sha256(array_to_string(w[21:30], ' ') || '|' || array_to_string(w[31:40], ' ')) END AS decisions
    FROM d WHERE len(w) >= 40""")
def src7_summaries(spark, sf_dir):
    """documents as summaries in front matter and Markdown, read back; some are placeholders, contradict themselves or aren't summaries."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    d = B.table(spark, sf_dir, "documents").withColumn("w", w).filter(F.size("w") >= 40)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    head = F.concat(F.lit("---\nsource_hash: a\nsource_prefix_hash: "), F.when(F.col("doc_id") % 17 == 0, "b").otherwise("a"), F.when(F.col("doc_id") % 13 == 0, "\nsummary_placeholder: true").otherwise(""), F.lit("\ntags: [x]\n---\n"))
    title = F.when((F.col("doc_id") % 19 == 0), "").otherwise(F.concat(F.lit("# T "), F.col("doc_id").cast("string")))
    head = F.when((F.col("doc_id") % 13 == 0), F.regexp_replace(head, "source_prefix_hash: b", "source_prefix_hash: a")).otherwise(head)
    content = F.concat(head, title, F.lit("\n\n## Goal\n"), part(1, 20), F.lit("\n\n## Decisions\n- "), part(21, 10), F.lit("\n- "), part(31, 10), F.lit("\n"))
    blobs = d.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("source_hash"), F.lit(None).cast("timestamp").alias("archived_at"), content.cast("binary").alias("content"))
    s = summaries.summaries(blobs)
    return s.select("source_hash", "reason", "title", F.sha2("goal", 256).alias("goal"), F.when(F.col("title").isNotNull(), F.sha2(F.array_join("decisions", "|"), 256)).alias("decisions"))
