"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.columns import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op1_token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op2_packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op3_fertility import judge_documents

    return judge_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op4_exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op5_mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op6_html import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op7_substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


#: What the entries of the list name, in turn (kind, pattern).
LISTED = (
    ("domain", "example.com"), ("domain", "example.net"), ("domain", "example.org"), ("label", "www"), ("label", "blog"), ("label", "m"),
    ("label", "cheap-pills"), ("path", "/en"), ("path", "/de"), ("path", "/fr"), ("path", "/es"),
)


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against a dated list of one entry per row of events.

    An event adds or removes (k even or odd), at its time, the pattern number event_id modulo their count, in the
    category of its type. pages has no time of fetching: page n is fetched n * 7919 seconds after the month of the
    events began, and again from its beginning.
    """
    from tallyloom.llm.op9_url_lists import active_entries

    captures = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(page_id * 7919, 2592000)) as fetched_at")
    patterns = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern")) for k, p in LISTED))
    entries = table(spark, sf_dir, "events").select(
        F.get(patterns, F.pmod("event_id", F.lit(len(LISTED))).cast("int")).alias("what"), F.col("event_type").alias("category"),
        F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "add").otherwise("remove").alias("action"), F.col("ts").cast("timestamp").alias("listed_at"),
    ).select("what.*", "category", "action", "listed_at")
    return active_entries(captures, entries).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


def op10_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op10_arc import archive_round_trip

    found = archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyloom.llm.op8_minhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), width=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_fertility": op3_fertility,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_html": op6_html,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash": op8_minhash,
    "op9_url_lists": op9_url_lists,
    "op10_arc": op10_arc,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
            FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (
            SELECT source, source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
                   row_number() OVER (ORDER BY source NULLS LAST) AS place, 2.0::DOUBLE * source_size AS cap
            FROM s),
        l AS (
            SELECT *, cap / weight AS fill,
                   (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0))
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
            FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (
            SELECT level FROM l WHERE fill > level ORDER BY fill, place LIMIT 1),
        t AS (
            SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM l),
        p AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS times,
                   CAST(floor(target + 0.5) AS BIGINT) AS goal
            FROM t),
        o AS (
            SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d)
        SELECT doc_id, size, source_size, target,
               CAST(times * size + greatest(0, least(size, goal - times * source_size - before)) AS BIGINT) AS taken
        FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source
    """,
    "op7_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        v AS (
            SELECT doc_id, unnest(range(1, len(words) - 18)) AS a, words FROM w WHERE len(words) >= 20),
        o AS (
            SELECT doc_id, a, row_number() OVER (PARTITION BY sha256(array_to_string(words[a:a + 19], ' ')) ORDER BY doc_id, a) AS nth FROM v),
        c AS (
            SELECT DISTINCT doc_id, a + k AS place FROM o, range(0, 20) t(k) WHERE nth > 1),
        i AS (SELECT doc_id, list(place) AS gone FROM c GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words
                      ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM w LEFT JOIN i USING (doc_id)
    """,
    "op8_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                   ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle
            FROM w),
        n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
            FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
        r AS (
            SELECT doc_id AS a, doc_id AS c FROM documents
            UNION
            SELECT r.a, e.b FROM r JOIN e ON e.a = r.c)
        SELECT d.doc_id, CAST(coalesce(n.n_shingles, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
    """,
    "op9_url_lists": rf"""
        WITH c AS (
            SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
                   TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 7919 % 2592000) AS fetched_at
            FROM pages),
        r(i, kind, pattern) AS (VALUES {', '.join(f"({i}, '{k}', '{p}')" for i, (k, p) in enumerate(LISTED))}),
        e AS (
            SELECT kind, pattern, event_type AS category, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 AS added, CAST(ts AS TIMESTAMP) AS valid_from,
                   lead(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY i, event_type ORDER BY ts, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2) AS valid_to
            FROM events JOIN r ON i = event_id % {len(LISTED)}),
        l AS (
            SELECT c.page_id, count(*) AS n, min(category) AS reason FROM c JOIN e
              ON CASE kind WHEN 'domain' THEN c.host = pattern OR ends_with(c.host, '.' || pattern)
                           WHEN 'label' THEN list_contains(string_split(c.host, '.'), pattern)
                           ELSE c.path = pattern OR starts_with(c.path, pattern || '/') END
             AND added AND valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)
            GROUP BY c.page_id)
        SELECT c.page_id, url, host, CAST(fetched_at AS VARCHAR)[:19] AS fetched_at, CAST(coalesce(n, 0) AS BIGINT) AS n_active, coalesce(n, 0) > 0 AS blocked, reason AS first_reason
        FROM c LEFT JOIN l USING (page_id)
    """,
    "op10_arc": r"""
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
